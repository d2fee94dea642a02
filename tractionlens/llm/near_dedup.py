"""Near-duplicate documents by bottom-k sketches: inverted lists of retained values, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractionlens.llm.shared import byte_slices, components, shingles, table, word_spans, written, Hasher

SETS = "doc_id long, key long, n_shingles long, f1 long, f2 long, sketch binary"


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, and where each text's begin (one more entry than texts)."""
    starts, ends, counts = word_spans(buf, offs)
    values, owner = shingles(Hasher(buf, lower=True).of(starts, ends), counts, k)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(offs)))


def _row_key() -> Column:
    """A long for (doc_id, text), null ids too: rows of one doc_id with different texts have different keys."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def sketches(docs: DataFrame, k: int, size: int) -> DataFrame:
    """doc_id, key of the row, number of shingles, a 128-bit fingerprint of the set, its `size` smallest values."""

    def sketch(batches):
        for batch in batches:
            for first, end, buf, offs in byte_slices(batch, "text"):
                values, at = shingle_sets(buf, offs, k)
                n = np.diff(at)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
                more = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * (values >> np.uint64(7) | np.uint64(1)))])
                lows = [values[a : min(b, a + size)].tobytes() for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, end - first) for i in range(2)), pa.array(n), pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)), pa.array((more[at[1:]] - more[at[:-1]]).view(np.int64)), pa.array(lows, pa.binary())],
                    names=["doc_id", "key", "n_shingles", "f1", "f2", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("key"), "text").mapInArrow(sketch, SETS)


def _estimated(pairs: DataFrame, sketch: DataFrame, size: int, least: float) -> DataFrame:
    """Pairs whose union-sketch estimate is at least `least`: of the `size` smallest values of both, the share found in both."""
    a = sketch.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = sketch.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def estimate(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                twice = both[1:] == both[:-1]
                union = both[np.concatenate([[True], ~twice])]
                bound = union[min(size, len(union)) - 1]
                keep.append((both[1:][twice] <= bound).sum() >= least * min(size, len(union)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(estimate, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on the full sets."""

    def verify(batches):
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for first, end, buf, offs in byte_slices(batch, "ta"):
                other = batch.slice(first, end - first)
                va, at_a = shingle_sets(buf, offs, k)
                done = 0
                for f2, e2, buf2, offs2 in byte_slices(other, "tb"):
                    vb, at_b = shingle_sets(buf2, offs2, k)
                    for i in range(f2, e2):
                        x, y = va[at_a[i] : at_a[i + 1]], vb[at_b[i - f2] : at_b[i - f2 + 1]]
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        keep[first + i] = common and 100 * common >= percent * (len(x) + len(y) - common)
                    done = e2
                assert done == len(other)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    a, b = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def _blockwise(groups: DataFrame, texts: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Links between members (p, rep, c) of a group p that lie in different components c. A group is cut into blocks by hash;
    each pair of blocks is one task's work of bounded size."""
    sizes = groups.groupBy("p").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = groups.join(sizes, "p").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("p", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "c").join(texts, "rep")

    def compare(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        rep, c = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("rep", "c"))
        values, sizes = [], []
        for _, _, buf, offs in byte_slices(batch, "text"):
            v, at = shingle_sets(buf, offs, k)
            values.append(v)
            sizes.append(np.diff(at))
        n = np.concatenate(sizes)
        if (c == c[0]).all():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        _, of, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(n)), n)
        shared = count[of] > 1
        slot = np.cumsum(count > 1) - 1
        column, owner = slot[of[shared]], owner[shared]
        common = np.zeros((len(n), len(n)), np.float32)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for lo in range(0, int((count > 1).sum()), 4096):
            part = slice(*np.searchsorted(column, [lo, lo + 4096]))
            m = np.zeros((len(n), 4096), np.float32)
            m[owner[part], column[part] - lo] = 1
            common += m @ m.T
        x, y = np.nonzero((100 * common >= percent * (n[:, None] + n[None, :] - common)) & (rep[:, None] < rep[None, :]) & (c[:, None] != c[None, :]) & (common > 0))
        return pa.table({"a": rep[x], "b": rep[y]})

    return dealt.groupBy("p", "i", "j").applyInArrow(compare, "a long, b long")


def links(docs: DataFrame, sets: DataFrame, k: int, percent: int, size: int, small: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(classes of equal sets, links between classes that join all their components).

    A value's list is worked off from a pivot, its member with the most common values: all members are compared with it, which settles lists whose members are all
    near copies of one text in as many pairs as members. What it leaves open (lists that still span components) is compared
    without emitting pairs: short lists by a join on the value, long ones in blocks of `block` by `block` members, from which
    only links come out. So no pair that could join two components stays untested."""
    share = percent / 100
    by = ["n_shingles", "f1", "f2"]
    first = F.min(F.struct("key", "sketch")).alias("first")
    classes = sets.where("n_shingles > 0").groupBy(*by).agg(first, F.min("doc_id").alias("least")).select(F.monotonically_increasing_id().alias("rep"), *by, "least", "first.*")
    classes = written(classes, "classes")  # once: the numbers of the classes stay
    reps = classes.select("rep", F.col("n_shingles").alias("n"), "sketch")

    def explode(batches):
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
            n = [len(p) for p in parts]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(batch.column(1).to_numpy(), n))], names=["v", "rep", "n"])

    flat = reps.mapInArrow(explode, "v long, rep long, n long")
    shared = flat.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    flat = flat.join(shared, "v")
    # rare values first: two sketches that share `need` values share one among the first (values - need + 1) of each
    exact = int(size * share)  # up to here, sketches of both are whole sets
    kept = F.least("n", F.lit(size))
    need = F.when(F.col("n") <= exact, F.ceil(F.col("n") * percent / 100)).otherwise(int(size * 0.4))
    ordered = F.sort_array(F.collect_list(F.struct("df", "v")))
    lists = flat.groupBy("rep", "n").agg(ordered.alias("vs"))
    alone = kept - F.size("vs")  # values that no other sketch has come first
    # a text near the middle of a group has the values that most others have
    lists = lists.withColumn("weight", F.aggregate("vs", F.lit(0).cast("long"), lambda a, x: a + x["df"]))
    lists = lists.withColumn("vs", F.slice("vs", F.lit(1), F.greatest(F.lit(0), (kept - need + 1 - alone).cast("int"))))
    lists = written(lists.select("rep", "n", "weight", F.explode("vs.v").alias("v")), "lists")
    heaviest = F.max(F.struct("weight", (-F.col("rep")).alias("key"), "rep", "n")).alias("p")

    near = lambda a, b: (F.least(a, b) * 100 >= F.greatest(a, b) * percent)
    least = max(0.0, share - 0.4)
    head = lists.groupBy("v").agg(heaviest, F.count("*").alias("m")).where("m > 1")
    pairs = lists.join(head, "v").where(F.col("rep") != F.col("p.rep")).where(near(F.col("n"), F.col("p.n")))
    pairs = pairs.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b")).distinct()
    tested = written(pairs, "pairs")
    wanted = lists.join(head.select("v"), "v", "left_semi").select("rep").distinct()
    keyed = docs.select(_row_key().alias("key"), "text").join(classes.select("rep", "key").join(wanted, "rep", "left_semi"), "key")
    texts = written(keyed.select("rep", "text").dropDuplicates(["rep"]), "texts")  # rows that are equal have one key
    check = lambda p: written(_verified(_estimated(p, reps, size, least), texts, k, percent), "links")
    found = check(tested)
    named = components(found)
    now = lists.join(named, lists.rep == named.id, "left").select("v", "rep", "n", F.coalesce("component", "rep").alias("c"))
    still = now.groupBy("v").agg(F.count("*").alias("m"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("m > 2 AND c1 <> c2")
    now = written(now.join(still.select("v", "m"), "v"), "open")
    short = now.where(F.col("m") <= small)
    x, y = short.select("v", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca")), short.select("v", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    rest = x.join(y, "v").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near(F.col("na"), F.col("nb"))).select("a", "b")
    rest = written(rest.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    # long lists with one pivot are one group, so that a pair that shares many of them is compared once
    groups = now.where(F.col("m") > small).join(head.select("v", F.col("p.rep").alias("p")), "v").select("p", "rep", "c").distinct()
    return classes, found.union(check(rest)).union(written(_blockwise(groups, texts, k, percent, block), "links"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, size: int = 64, small: int = 32, block: int = 256) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are A-Z lower-cased runs of non-space; a set holds the distinct k-word shingles, a text of fewer words its whole
    sequence, a null or empty text nothing (it links with nothing). Documents link at 100 * intersection >= percent * union
    of the full sets; component_id is the smallest doc_id reachable; kept is doc_id = component_id. Rows of one doc_id are
    one document with several texts: they link, and each row has its own n_shingles. Rows without doc_id link as any other;
    their component_id is the smallest id reachable, null if there is none, and they are kept only then. An empty table
    gives no rows. Only doc_id and text are read. A very long text costs memory in proportion to its words.

    Equal sets become one class first, with the text of one of its rows. Two texts at the threshold share 0.4 * size of the
    `size` smallest values of their union except with a chance below 1e-9 a pair (64 values, 0.8: binomial, 1e-12); sets up
    to 0.8 * size are kept whole: no chance at all."""
    sets = written(sketches(docs, k, size), "sets")
    by = ["n_shingles", "f1", "f2"]
    classes, found = links(docs, sets, k, percent, size, small, block)
    members = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", *by)
    several = members.groupBy("doc_id").agg(F.min(F.xxhash64(*by)).alias("_l"), F.max(F.xxhash64(*by)).alias("_h")).where("_l <> _h").select("doc_id")
    again = members.join(several, "doc_id").join(classes.select("rep", *by), by).select("doc_id", "rep").distinct()
    same = again.join(again.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))
    named = components(found.union(same))
    linked = classes.select("rep", "least").join(named, F.col("rep") == F.col("id")).select("rep", "least", "component")
    smallest = linked.groupBy("component").agg(F.min("least").alias("_c"))
    group = classes.join(linked.join(smallest, "component").select("rep", "_c", F.lit(True).alias("_linked")), "rep", "left")
    group = group.select(*by, F.when(F.col("_linked"), F.col("_c")).otherwise(F.col("least")).alias("_c"))
    out = sets.select("doc_id", *by).join(group, by, "left")
    component: Column = F.coalesce("_c", "doc_id")
    kept = F.when(F.col("doc_id").isNull(), component.isNull()).otherwise(component == F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = w.doc_id AS kept
FROM w JOIN m ON m.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLES = {"op9_near_dedup": _SQL}
