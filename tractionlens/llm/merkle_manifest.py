"""Merkle manifest of a table: leaves are appended to aligned subtrees whose open nodes carry partial witnesses."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractionlens.llm.shared import numbered, table, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
GROWN = "grp string, pos long, carried binary, digest binary, witness binary, grown binary, total long"


def joined(digests: list[bytes]) -> bytes:
    """The digest of a node: sha256 of its children's digests as hex text, one after the other."""
    return hashlib.sha256("".join(x.hex() for x in digests).encode()).digest()


@dataclass
class Open:
    """A finished subtree whose run of siblings is still open: its leaves, and what its witness at this level holds so far."""

    digest: bytes
    first: int
    end: int
    left: int
    partial: bytearray = field(default_factory=bytearray)


class Appender:
    """A tree that grows by appended leaves. A finished subtree takes the digests of the siblings before it when it joins its
    run, and each sibling that is finished later extends it. A full run closes: its subtrees' entries go to their leaves'
    witnesses and its digest joins the run above. An entry of a witness is two bytes (siblings left, right) and their digests."""

    def __init__(self, arity: int):
        self.arity, self.runs, self.witnesses = arity, [], []

    def append(self, digest: bytes) -> None:
        self.witnesses.append(bytearray())
        self._join(0, digest, len(self.witnesses) - 1, len(self.witnesses))

    def _join(self, level: int, digest: bytes, first: int, end: int) -> None:
        if level == len(self.runs):
            self.runs.append([])
        run = self.runs[level]
        node = Open(digest, first, end, len(run), bytearray(b"".join(x.digest for x in run)))
        for x in run:
            x.partial += digest
        run.append(node)
        if len(run) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        for x in run:
            entry = bytes((x.left, len(run) - 1 - x.left)) + x.partial
            for i in range(x.first, x.end):
                self.witnesses[i] += entry
        self._join(level + 1, joined([x.digest for x in run]), run[0].first, run[-1].end)

    def finish(self, levels: int | None = None) -> bytes:
        """The root after no more leaves come: of the whole tree, or `levels` above the leaves where the tree goes on above."""
        level = 0
        while True:
            run = self.runs[level]
            done = len(run) == 1 and not any(self.runs[level + 1 :]) if levels is None else level == levels
            if done:
                return run[0].digest
            if run:
                self._close(level)
            level += 1


def siblings(witness: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    """The witness level by level: digests to the left and to the right."""
    out, at = [], 0
    while at < len(witness):
        left, right = witness[at], witness[at + 1]
        digests = [witness[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(left + right)]
        out.append((digests[:left], digests[left:]))
        at += 2 + 32 * (left + right)
    return out


def folded(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and a witness give."""
    for left, right in siblings(witness):
        leaf = joined([*left, leaf, *right])
    return leaf


def proof(witness: bytes) -> str:
    return hashlib.sha256("".join(x.hex() for left, right in siblings(witness) for x in left + right).encode()).hexdigest()


def leaf_digest(text: Column) -> Column:
    """The digest of a row whose text is `text`, as bytes: each field is - if null, else its UTF-8 byte count, a colon, its value."""
    parts = [text if name == "text" else F.col(name).cast("string") for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]).cast("binary"), 256))


def grown(nodes: DataFrame, arity: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Of nodes (grp, pos, total, digest, carried): the nodes with block and witness inside the block, and the roots of the
    blocks as the next nodes. A block is an aligned subtree of arity ** levels nodes; a group of one block ends at its root."""
    size = arity**levels

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree = Appender(arity)
        for digest in table.column("digest").to_pylist():
            tree.append(digest)
        total = table.column("total")[0].as_py()
        root = tree.finish(levels if total > size else None)
        witnesses = [bytes(x) for x in tree.witnesses]
        cols = {c: table.column(c) for c in ("grp", "pos", "carried", "digest")}
        return pa.table(cols | {"witness": pa.array(witnesses, pa.binary()), "grown": pa.array([root] + [None] * (len(witnesses) - 1), pa.binary()), "total": table.column("total")})

    block = F.floor(F.col("pos") / size)
    out = nodes.select("grp", "pos", "total", "digest", "carried", block.alias("block")).groupBy("grp", "block").applyInArrow(grow, GROWN)
    out = written(out.withColumn("block", block), "grown")
    roots = out.where("grown IS NOT NULL").select("grp", F.col("block").alias("pos"), F.ceil(F.col("total") / size).alias("total"), F.col("grown").alias("digest"), F.lit(None).cast("binary").alias("carried"))
    return out.drop("grown"), roots


def forest(nodes: DataFrame, arity: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of blocks until each group has one root: the nodes of each round with their witnesses, and (grp, digest)."""
    rounds: list[DataFrame] = []
    while True:
        out, nodes = grown(nodes, arity, levels)
        rounds.append(out)
        if (nodes.agg(F.max("total")).first()[0] or 0) <= 1:
            return rounds, nodes.select("grp", "digest")


def merkle_manifest(docs: DataFrame, arity: int = 3, levels: int = 7, tampered: Column | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, leaf, subroot, root (hex), witness (bytes, see Appender), proof_sha256 (of the
    witness's digests as hex text), folded_root and verified.

    A tree per source over its rows by doc_id (nulls first; rows of one doc_id by their digest), and one over the sources' roots,
    a null source first and then by UTF-8 bytes. Runs of `arity` nodes become their digest, the last run with fewer too, even
    one node, until one is left. `tampered` is the text to hash in place of the row's own when its witness is folded (null or
    equal: the row's own); a row whose text was changed then doesn't verify. Equal rows are leaves of their own. A null field
    has a mark of its own, so null and empty differ. An empty table gives no rows. Only the columns in FIELDS are read; a long
    text is hashed where it is read and only its digest moves.

    Leaves are dealt to aligned blocks of arity ** levels places, appended in order; roots of blocks are appended alike in
    the next round, and the sources' roots after them. A block is a task's unit of work, so a source with a third of all rows
    fills as many tasks as others. Each round is a table in the shared folder."""
    leaf = leaf_digest(F.col("text"))
    other = F.lit(None).cast("binary") if tampered is None else F.when(~tampered.eqNullSafe(F.col("text")) & tampered.isNotNull(), leaf_digest(tampered))
    source = F.col("source").cast("string")
    # a key that sorts as the sources do, a null source before an empty one
    group = F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))
    leaves = written(docs.select(group.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"), other.alias("carried")), "leaves")
    placed = numbered(leaves, ["doc_id", "digest", "carried"])
    ids = F.coalesce(F.unhex(F.lpad(F.hex("doc_id"), 16, "0")), F.lit(b"")).alias("carried")  # 8 bytes, none for null
    rounds, roots = forest(placed.select("grp", "pos", "total", "digest", F.concat(ids, F.coalesce("carried", F.lit(b""))).alias("carried")), arity, levels)
    tops = numbered(roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"])
    above, root = forest(tops.select("grp", "pos", "total", "digest", F.col("name").cast("binary").alias("carried")), arity, levels)

    def extended(lower: DataFrame, upper: DataFrame) -> DataFrame:
        """`lower` with the witnesses of the nodes that its blocks became."""
        up = upper.select("grp", F.col("pos").alias("block"), F.col("witness").alias("_up"), *[c for c in ("subroot", "root") if c in upper.columns])
        return lower.join(up, ["grp", "block"]).withColumn("witness", F.concat("witness", "_up")).drop("_up")

    top = above[-1].join(root.withColumnRenamed("digest", "root"), "grp")
    for lower in reversed(above[:-1]):
        top = extended(lower, top)
    top = top.select(F.col("carried").cast("string").alias("grp"), F.lit(0).cast("long").alias("pos"), "witness", F.col("digest").alias("subroot"), "root")
    out = extended(rounds[-1], top)
    for lower in reversed(rounds[:-1]):
        out = extended(lower, out)

    def checked(batches):
        for batch in batches:
            cols = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
            found = {k: [] for k in ("doc_id", "proof_sha256", "folded_root", "verified")}
            for carried, digest, witness, root in zip(cols["carried"], cols["digest"], cols["witness"], cols["root"]):
                id_, other = (carried[:8], carried[8:]) if len(carried) % 32 == 8 else (None, carried)
                again = folded(other or digest, witness)
                for k, v in zip(found, (int.from_bytes(id_, "big", signed=True) if id_ else None, proof(witness), again.hex(), again == root)):
                    found[k].append(v)
            hexed = lambda c: pa.array([x.hex() for x in cols[c]], pa.string())
            kinds = {"doc_id": pa.int64(), "verified": pa.bool_()}
            made = {k: pa.array(v, kinds.get(k, pa.string())) for k, v in found.items()}
            order = {"doc_id": made["doc_id"], "leaf": hexed("digest"), "subroot": hexed("subroot"), "root": hexed("root"), **made, "witness": batch.column("witness")}
            yield pa.RecordBatch.from_pydict(order)

    return out.select("carried", "digest", "subroot", "root", "witness").mapInArrow(checked, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, witness binary")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Rows with an even crc32 of their doc_id are tampered with: their text loses its line breaks. Without a doc_id: never."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even & F.contains("text", F.lit("\n")), F.translate("text", "\n", ""))
    return merkle_manifest(table(spark, sf_dir, "documents"), tampered=tampered).drop("witness")


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f"{{{name}}}" if name == "text" else name) for name in FIELDS) + ")"
#: crc32 bit by bit over the characters of the decimal doc_id.
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
_UP = "SELECT grp, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM {0} WHERE n > 1 GROUP BY grp, lvl, pos // 3, n"
#: A step of a fold hashes a run with one node replaced; after the last run of a source it goes on among the sources' roots.
_RUN = "JOIN nodes d ON d.grp = f.grp AND d.lvl = f.lvl AND d.pos // 3 = f.pos // 3"
ORACLES = {
    "op12_merkle_manifest": f"""WITH RECURSIVE hashed AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS grp, {_LEAF.format(text="text")} AS leaf,
  CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} END AS other FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER () AS id FROM hashed),
low(grp, lvl, pos, h, n) AS (SELECT grp, 0, pos, leaf, n FROM leaves UNION ALL {_UP.format("low")}),
sub AS (SELECT grp, lvl, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(grp, lvl, pos, h, n) AS (SELECT '', 0, pos, h, n FROM sub UNION ALL {_UP.format("high")}),
nodes AS (SELECT * FROM low WHERE n > 1 UNION ALL SELECT * FROM high),
fold(id, grp, lvl, pos, h, proof, src) AS (SELECT l.id, CASE WHEN l.n > 1 THEN l.grp ELSE '' END, 0, CASE WHEN l.n > 1 THEN l.pos ELSE s.pos END, coalesce(other, leaf), '', l.grp FROM leaves l JOIN sub s USING (grp)
  UNION ALL SELECT id, CASE WHEN up THEN '' ELSE grp END, CASE WHEN up THEN 0 ELSE lvl + 1 END, CASE WHEN up THEN (SELECT pos FROM sub WHERE sub.grp = src) ELSE pos // 3 END, h, proof, src FROM (
    SELECT f.id, f.grp, f.lvl, f.pos, f.src, f.grp <> '' AND any_value(d.n) <= 3 AS up, sha256(string_agg(CASE WHEN d.pos = f.pos THEN f.h ELSE d.h END, '' ORDER BY d.pos)) AS h,
    f.proof || coalesce(string_agg(d.h, '' ORDER BY d.pos) FILTER (d.pos <> f.pos), '') AS proof FROM fold f {_RUN} WHERE NOT (f.grp = '' AND d.n = 1) GROUP BY f.id, f.grp, f.lvl, f.pos, f.src, f.proof)),
last AS (SELECT id, h AS folded_root, proof FROM fold QUALIFY row_number() OVER (PARTITION BY id ORDER BY (grp = '') DESC, lvl DESC) = 1)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN last USING (id) JOIN sub USING (grp), (SELECT h AS root FROM high WHERE n = 1)"""
}
