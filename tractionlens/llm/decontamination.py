"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractionlens.llm.shared import byte_slices, shingles, table, trimmed, word_spans, Hasher

FOUND = "doc_id long, row long, contaminated boolean, coverage double, best_item long, items array<long>, n_tiles int"


def token_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased words without punctuation at their ends, as hashes; and the words before each text."""
    starts, ends, counts = word_spans(buf, offs)
    return Hasher(buf, lower=True).of(*trimmed(buf, starts, ends)), counts


def _runs(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """All maximal matches of at least `least` words, as (-length, doc start, item start).

    Karp-Rabin hashes of `least` words find the seeds; seeds that follow each other on a diagonal are one match. Each item
    position meets only the document positions of its own hash, and only the ends of matches are kept, so a word that repeats
    all along item and document gives as many matches as there are diagonals, not as there are pairs."""
    keys, windows = _windows(item, least), _windows(doc, least)
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    lo, hi = np.searchsorted(ordered, keys), np.searchsorted(ordered, keys, side="right")
    at = {int(a): order[a:b] for a, b in zip(lo, hi) if a < b}
    seeds = [int(a) if a < b else -1 for a, b in zip(lo, hi)]
    starts, ends, known = [], [], {}
    for i, seed in enumerate(seeds):
        if seed < 0:
            continue
        for out, other, step in ((starts, seeds[i - 1] if i else -1, 1), (ends, seeds[i + 1] if i + 1 < len(seeds) else -1, -1)):
            if (seed, other, step) not in known:
                known[seed, other, step] = at[seed][~_among(at[seed], at[other] + step)] if other >= 0 else at[seed]
            new = known[seed, other, step]
            if len(new):
                out.append(np.stack([new - i, np.full(len(new), i)]))
    if not starts:
        return []
    (d, i), (e, k) = (x[:, np.lexsort((x[1], x[0]))] for x in (np.concatenate(starts, axis=1), np.concatenate(ends, axis=1)))
    return list(zip((i - k - least).tolist(), (d + i).tolist(), i.tolist()))


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the table; both ascend."""
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, doc start, length), longest first, none overlapping in item or document; ties go to
    the first in the document, then in the item.

    Every match that is left once tiles are marked is a part of a maximal one, so a maximal match whose words are taken
    comes back as its free parts until they are shorter than `least`."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    heap, out = _runs(item, doc, least), []
    heapq.heapify(heap)
    left = len(item)
    while heap and left >= least:
        n, j, i = heapq.heappop(heap)
        free = free_item[i : i - n] & free_doc[j : j - n]
        if free.all():
            free_item[i : i - n] = free_doc[j : j - n] = False
            out.append((i, j, -n))
            left += n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= least:
                heapq.heappush(heap, (a - b, j + a, i + a))
    return out


def _windows(tokens: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all windows of n tokens."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(tokens) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + len(out)]
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = 5,
    threshold: float = 0.6,
    block_tokens: int = 1_000_000,
) -> DataFrame:
    """One row per document: doc_id, contaminated, coverage, best_item, items (contaminating item_ids), n_tiles.

    coverage is the largest share of an item's words that tiles of at least `least` words cover; a document is contaminated
    from `threshold` on. Tiles may come in any order, so reordered passages count. An item with fewer than `least` words
    is matched whole. Items without a word match nothing; an item without item_id contaminates but has no place in items and
    best_item. Null and empty documents are clean. Ties between items go to the smaller item_id; repeated rows are judged
    each. An empty table of documents gives no rows, an empty benchmark no finding. Only doc_id, item_id and the texts are
    read, so other columns may have any name. A very long document costs time in proportion to its words for each item
    that it shares a seed with.

    The benchmark is the query set: it is read in blocks of at most `block_tokens` words, each sent to the tasks, and the
    documents are scanned once for each block without a shuffle. Only when there are several blocks are their findings
    grouped by document."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    sizes = items.select(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    n_blocks = -(-total // block_tokens) or 1
    found, keyed = None, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    for k in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k) if n_blocks > 1 else items
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r))
        block = keyed.mapInArrow(_scan(rows, least, threshold), FOUND)
        found = block if found is None else found.union(block)
    if n_blocks == 1:
        return found.drop("row")
    best = F.min(F.struct((-F.col("coverage")).alias("c"), F.coalesce("best_item", F.lit(2**63 - 1)).alias("i"), "best_item"))
    copies = (F.count("*") / n_blocks).cast("int")  # rows that are equal, each of which is in every block
    merged = found.groupBy("doc_id", "row").agg(F.max("contaminated").alias("contaminated"), F.max("coverage").alias("coverage"), best.alias("_b"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.sum("n_tiles").alias("_t"), copies.alias("_n"))
    merged = merged.select("*", F.explode(F.array_repeat(F.lit(0), F.col("_n"))))
    return merged.select("doc_id", "contaminated", "coverage", F.col("_b.best_item").alias("best_item"), "items", (F.col("_t") / F.col("_n")).cast("int").alias("n_tiles"))


def _scan(rows: list[tuple[int, str]], least: int, threshold: float):
    texts = [t.encode("utf-8", "surrogatepass") for _, t in rows]

    def scan(batches):
        joined = b" ".join(texts)
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        offs = np.concatenate([[0], ends]).astype(np.int64)
        offs[-1] = len(joined)
        hashes, counts = token_hashes(np.frombuffer(joined, np.uint8), offs) if texts else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        own = [hashes[a:b] for a, b in zip(counts, counts[1:])]
        seeds, of = shingles(hashes, counts, least) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        short = {n: [i for i, x in enumerate(own) if len(x) == n] for n in range(1, least)}
        long_enough = np.array([len(x) >= least for x in own], bool)
        seeds, of = (seeds[long_enough[of]], of[long_enough[of]]) if len(of) else (seeds, of)
        order = np.argsort(seeds, kind="stable")
        seeds, of = seeds[order], of[order]
        for batch in batches:
            for first, end, buf, offs_d in byte_slices(batch, "text"):
                n = end - first
                words, before = token_hashes(buf, offs_d)
                windows, owner = shingles(words, before, least)
                begin = np.searchsorted(owner, np.arange(n + 1))
                hit = np.zeros(len(windows), bool)
                if len(seeds) and len(windows):
                    left = np.searchsorted(seeds, windows)
                    hit = seeds[np.minimum(left, len(seeds) - 1)] == windows
                at_all = np.flatnonzero(hit)
                whole = _whole(words, before, own, short)
                dirty, cover, best, lists, tiled = np.zeros(n, bool), np.zeros(n), [None] * n, [[] for _ in range(n)], np.zeros(n, np.int32)
                for d in np.unique(np.concatenate([owner[at_all], np.array(sorted(whole), np.int64)])):
                    at = at_all[np.searchsorted(at_all, begin[d]) : np.searchsorted(at_all, begin[d + 1])]
                    seen = np.unique(windows[at])
                    lo, hi = np.searchsorted(seeds, seen), np.searchsorted(seeds, seen, side="right")
                    doc = words[before[d] : before[d + 1]]
                    for i in sorted({*whole.get(d, ()), *(int(i) for a, b in zip(lo, hi) for i in of[a:b])}):
                        got = tiles(own[i], doc, min(least, len(own[i])))
                        share = sum(x for _, _, x in got) / len(own[i])
                        tiled[d] += len(got)
                        if share > cover[d]:
                            cover[d], best[d] = share, rows[i][0]
                        if share >= threshold:
                            dirty[d] = True
                            if rows[i][0] is not None:
                                lists[d].append(rows[i][0])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, n) for c in range(2)), pa.array(dirty), pa.array(cover), pa.array(best, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(tiled)],
                    names=["doc_id", "row", "contaminated", "coverage", "best_item", "items", "n_tiles"],
                )

    return scan


def _whole(words: np.ndarray, before: np.ndarray, own: list[np.ndarray], short: dict[int, list[int]]) -> dict[int, set[int]]:
    """The documents that hold items of fewer words than a seed, with those items."""
    out: dict[int, set[int]] = {}
    for n, those in short.items():
        if not those or len(words) < n:
            continue
        keys = np.array([_windows(own[i], n)[0] for i in those])
        order = np.argsort(keys, kind="stable")
        windows = _windows(words, n)
        at = np.flatnonzero(np.isin(windows, keys))
        doc = np.searchsorted(before, at, side="right") - 1
        inside = at + n <= before[doc + 1]
        pairs = np.unique(np.stack([doc[inside].astype(np.uint64), windows[at[inside]]]), axis=1)
        lo, hi = np.searchsorted(keys[order], pairs[1]), np.searchsorted(keys[order], pairs[1], side="right")
        for d, a, b in zip(pairs[0].astype(int).tolist(), lo, hi):
            out.setdefault(d, set()).update(those[k] for k in order[a:b])
    return out


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES: dict[str, str] = {}
