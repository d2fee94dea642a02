"""Divergence of sources by their terms: pointers to token starts are sorted per shard, equal runs are counted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractionlens.llm.shared import byte_slices, table, word_spans, written, _LOWER

RUNS = "lang string, source string, term string, docs long, n long"
FOUND = "lang string, source string, part string, item string, value long"
SCALE = 1_000_000_000

_GAP = np.ones(256, bool)
_GAP[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_KEEP = np.array([(2**64 - 1) ^ (2 ** (8 * (8 - k)) - 1) for k in range(9)], np.uint64)
_LEAF = 1 << 15


class Pointers:
    """Pointers to the starts of the tokens of a buffer, in the order of the tokens' bytes; equal tokens keep their order."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends = starts, ends
        self.view = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(8, np.uint8)]), 8)
        self.order = np.arange(len(starts))
        self.head = np.zeros(len(starts), bool)  # where a run of equal tokens begins
        self._sort()

    def _key(self, tokens: np.ndarray, depth: int) -> np.ndarray:
        """The 8 bytes of each token from 8 * depth on as one number, zero past the end. No token holds a zero byte, so one
        whose number ends in zero has ended."""
        at = self.starts[tokens] + 8 * depth
        left = np.clip(self.ends[tokens] - at, 0, 8)
        word = self.view[np.minimum(at, len(self.view) - 1)].view(">u8")[:, 0].astype(np.uint64)
        return word & _KEEP[left]

    def _sort(self) -> None:
        """Multikey quicksort: a slice is parted into less, equal and greater by 8 bytes of a pivot; the equal part goes on with
        the next 8 bytes. Small slices are sorted at once."""
        stack = [(0, len(self.order), 0)] if len(self.order) else []
        while stack:
            lo, hi, depth = stack.pop()
            own = self.order[lo:hi]
            key = self._key(own, depth)
            if hi - lo <= _LEAF:
                self._leaf(lo, key, depth)
                continue
            sample = np.sort(key[:: max(1, (hi - lo) // 63)])
            pivot = sample[len(sample) // 2]
            less, same = key < pivot, key == pivot
            self.order[lo:hi] = np.concatenate([own[less], own[same], own[~(less | same)]])
            a = lo + int(less.sum())
            b = a + int(same.sum())
            stack += [x for x in ((lo, a, depth), (b, hi, depth)) if x[0] < x[1]]
            if pivot & np.uint64(0xFF):
                stack.append((a, b, depth + 1))
            else:
                self.head[a] = True

    def _leaf(self, lo: int, key: np.ndarray, depth: int) -> None:
        by = np.argsort(key, kind="stable")
        own, key = self.order[lo : lo + len(key)][by], key[by]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        while True:
            # tokens that are equal so far and go on
            run = np.cumsum(new) - 1
            live = np.flatnonzero((key & np.uint64(0xFF) != 0) & (np.bincount(run)[run] > 1))
            if not len(live):
                break
            depth += 1
            more = self._key(own[live], depth)
            by = np.lexsort((more, run[live]))
            own[live], more = own[live[by]], more[by]
            key[:] = 0
            key[live] = more
            new[live[1:]] |= (more[1:] != more[:-1]) & (run[live[1:]] == run[live[:-1]])
        self.order[lo : lo + len(own)] = own
        self.head[lo : lo + len(own)] = new


def runs(buf: np.ndarray, offs: np.ndarray, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, documents, occurrences) of each term in each group of the texts in `buf` (lower-cased); groups: a number a text."""
    starts, ends, before = word_spans(buf, offs, _GAP)
    if not len(starts):
        return pa.array([], pa.string()), *[np.zeros(0, np.int64)] * 3
    p = Pointers(buf, starts, ends)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(before))[p.order]
    cell = (np.cumsum(p.head) - 1) * (int(groups.max()) + 1) + groups[doc]
    by = np.argsort(cell, kind="stable")
    cell, doc, token = cell[by], doc[by], p.order[by]
    new = np.ones(len(cell), bool)
    new[1:] = cell[1:] != cell[:-1]
    at = np.flatnonzero(new)
    another = new.copy()
    another[1:] |= doc[1:] != doc[:-1]
    first = token[at]
    size = ends[first] - starts[first]
    cuts = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(starts[first] - cuts[:-1], size) + np.arange(cuts[-1])]
    terms = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    return terms, groups[doc[at]], np.add.reduceat(another.astype(np.int64), at), np.diff(np.append(at, len(cell)))


def term_counts(docs: DataFrame, slice_bytes: int = 8 << 20) -> DataFrame:
    """(lang, source, term, docs, n): documents with the term and its occurrences, added up over the shards.

    Null text, lang and source are ''. A term is a run of ASCII letters and characters beyond ASCII, only A-Z lower-cased. Texts
    are counted whole in slices of about `slice_bytes`; a slice sends one row per term and group."""

    def counted(batches):
        for batch in batches:
            lang, source = (pc.cast(batch.column(i), pa.large_string()) for i in (0, 1))
            for first, end, buf, offs in byte_slices(batch, "text", slice_bytes):
                names, inverse = [], np.zeros(end - first, np.int64)
                known: dict[tuple[str, str], int] = {}
                for i, pair in enumerate(zip(lang.slice(first, end - first).to_pylist(), source.slice(first, end - first).to_pylist())):
                    if pair not in known:
                        known[pair] = len(names)
                        names.append(pair)
                    inverse[i] = known[pair]
                terms, group, n_docs, n = runs(_LOWER[buf], offs, inverse)
                group = pa.array(group)
                langs, sources = (pa.array([x[k] for x in names], pa.string()).take(group) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([langs, sources, pc.cast(terms, pa.string()), pa.array(n_docs), pa.array(n)], names=["lang", "source", "term", "docs", "n"])

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    sent = docs.select(*text).mapInArrow(counted, RUNS)
    # one shuffle: all that follows is by (lang, term) or by more
    return sent.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) without a product beyond 64 bits: long division by three digits of a thousand."""
    out, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / (p + q)); both lie between 1 and SCALE + 1, so squares fit 64 bits."""
    return (p - q) ** 2 // (p + q)


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10, shard_terms: int = 20_000, block: int = 64) -> DataFrame:
    """How far each source of a language is from its other sources, and the terms that set it apart: lang, source, part, item,
    value, rank.

    A language keeps the terms that at least `least` of its documents hold. With c a term's occurrences in a group, N the
    group's occurrences of kept terms and V the language's kept terms, p = 1 + floor(SCALE * (c + 2) / (N + 2 * V)). Part
    `pair`: the item is another source, the value the sum of divergence() over all kept terms (0 without any). Part `term`: the
    item is a term that the source has and holds a larger share of than the language does, the value its divergence(); the
    `top` first. Ranks go by value, then by the item's UTF-8 bytes. A source without terms has pairs and no terms. Null lang,
    source and text are ''. Repeated rows count as documents of their own. An empty table gives no rows. Other columns aren't
    read. All arithmetic is exact up to 9 * 10**15 occurrences of kept terms a language.

    Kept terms are dealt to shards; each shard gets the counts of its terms and, block by block, the totals of a language's
    sources, and sends sums. A language's sources meet pairwise because the result holds their pairs."""
    kept = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = written(kept.where(F.col("docs") >= least).drop("docs"), "terms")
    shards = max(1, -(-kept.count() // shard_terms))

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    n = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = named.join(n, ["lang", "source"], "left").join(v, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    blocks = groups.groupBy("lang").agg((F.floor((F.count("*") - 1) / block) + 1).alias("blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    dealt = kept.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard"), "term", "total", "counts", every)
    totals = groups.join(blocks, "lang").select("lang", "source", "n", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "blocks").select("lang", "shard", "source", "n", "v", every)

    def compare(key: tuple[pa.Scalar, ...], terms: pa.Table, sources: pa.Table) -> pa.Table:
        lang, _, number = (x.as_py() for x in key)
        sources = sources.sort_by("source").combine_chunks()
        names = sources.column("source").combine_chunks()
        size, v = sources.column("n").to_numpy(), int(sources.column("v")[0].as_py())
        own = np.arange(number * block, min(len(names), (number + 1) * block))
        terms = terms.sort_by("term").combine_chunks()
        counts = terms.column("counts").combine_chunks()
        sums = np.zeros((len(own), len(names)), np.int64)
        out = []
        if len(terms):
            cells = counts.flatten()
            row = np.repeat(np.arange(len(terms)), pc.list_value_length(counts).to_numpy())
            column = pc.index_in(cells.field("source"), value_set=names).to_numpy()
            c = cells.field("n").to_numpy()
            q = share(terms.column("total").to_numpy() + 2, size.sum() + 2 * v)
            step = max(1, (1 << 21) // len(names))
            best: dict[int, list[tuple[int, int]]] = {int(k): [] for k in own}
            for at in range(0, len(terms), step):
                m = min(step, len(terms) - at)
                inside = (row >= at) & (row < at + m)
                dense = np.zeros((m, len(names)), np.int64)
                dense[row[inside] - at, column[inside]] = c[inside]
                p = share(dense + 2, (size + 2 * v)[None, :])
                for i, k in enumerate(own):
                    sums[i] += divergence(p[:, k : k + 1], p).sum(axis=0)
                    above = np.flatnonzero((dense[:, k] > 0) & (p[:, k] > q[at : at + m]))
                    value = divergence(p[above, k], q[at + above])
                    first = np.argsort(-value, kind="stable")[:top]
                    best[int(k)] += [(-int(value[j]), int(at + above[j])) for j in first]
            word = terms.column("term")
            out = [(lang, names[k].as_py(), "term", word[t].as_py(), -value) for k, found in best.items() for value, t in sorted(found)[:top]]
        listed = names.to_pylist()
        out += [(lang, listed[k], "pair", listed[h], int(sums[i, h])) for i, k in enumerate(own) for h in range(len(listed)) if h != k]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        columns = zip(*out) if out else [[]] * 5
        return pa.table({name: pa.array(list(x), kind) for name, x, kind in zip(("lang", "source", "part", "item", "value"), columns, kinds)})

    by = ("lang", "shard", "block")
    found = dealt.groupBy(*by).cogroup(totals.groupBy(*by)).applyInArrow(compare, FOUND)
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


_SHARE = "1 + (1000000000::HUGEINT * ({0} + 2)) // ({1} + 2 * v)"
_F = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})"
QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {
    "op13_source_divergence": f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
l AS (SELECT lang, sum(total)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
p AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS c, {_SHARE.format("coalesce(c.n, 0)", "g.n")} AS p, {_SHARE.format("kept.total", "l.n")} AS q FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT lang, a.source, b.source AS item, coalesce(s, 0)::BIGINT AS value FROM g a JOIN g b USING (lang) LEFT JOIN (SELECT lang, a.source AS x, b.source AS y, sum({_F.format('a.p', 'b.p')}) AS s FROM p a JOIN p b USING (lang, term) GROUP BY ALL) m ON m.lang = a.lang AND x = a.source AND y = b.source WHERE a.source <> b.source),
top AS (SELECT lang, source, term AS item, ({_F.format('p', 'q')})::BIGINT AS value FROM p WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM (SELECT lang, source, 'pair' AS part, item, value FROM pair)
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM top) WHERE rank <= 10"""
}
