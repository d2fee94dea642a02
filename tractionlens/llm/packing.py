"""Best-fit packing by minimum bin slack: per bin, a bitset subset-sum over the lengths at hand finds the fullest fill."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractionlens.llm.shared import table, written
from tractionlens.llm.subwords import default_path, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of `capacity`; a remainder is the first piece."""

    def cut(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            out: list[tuple] = []
            for doc, text in zip(ids.to_pylist(), texts):
                data = enc.packed(text.as_py() or "") + end
                n = len(data) // 4
                first = n % capacity or min(n, capacity)
                edges = [0, *range(first, n + 1, capacity)]
                out += [(doc, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The fullest multiset of lengths within `room`: bit s of `reach` says that some choice sums to s."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return chosen


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(fill, times)]: bins by minimum bin slack. A bin takes the longest length left and the fullest fill of the rest;
    the same fill is repeated while its lengths last, so the steps are bounded by the distinct lengths, not by the rows."""
    left, bins = dict(lengths), []
    while left:
        longest = max(left)
        left[longest] -= 1
        fill = fullest(left, capacity - longest)
        left[longest] += 1
        fill[longest] += 1
        times = min(left[x] // n for x, n in fill.items())
        bins.append((dict(fill), times))
        for x, n in fill.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return bins


def _ranges(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, per bin, first sequence, offset in the bin), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for fill, times in bins:
        offset = 0
        for length in sorted(fill, reverse=True):
            out.setdefault(length, []).append((used[length], fill[length], sequence, offset))
            used[length] += fill[length] * times
            offset += length * fill[length]
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty: one piece that holds the end id. Equal documents and repeated doc_ids are packed row by
    row. An empty table gives no rows. Only doc_id and text are read.

    Rows are tokenized once and written to the shared folder. The driver sees the histogram of lengths, which has at most
    `capacity` rows at any input size, and plans on it; a piece finds its place from its rank among the pieces of its
    length. Ranks come from counts by (length, bucket), so a hot length is spread over many tasks."""
    pieces = written(token_pieces(docs, tokenizer or default_path(), capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges = _ranges(plan(histogram, capacity))
    buckets = max(16, max(histogram.values(), default=0) // 20_000)
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = before.select("length", "_bucket", (F.sum("_n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("_row", rank).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_row") + F.col("_before"))

    def place(batches):
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            values, heads = np.unique(lengths[order], return_index=True)
            for length, rows in zip(values, np.split(order, heads[1:])):
                table = ranges[int(length)]
                at = table[np.searchsorted(table[:, 0], ranks[rows], side="right") - 1]
                within = ranks[rows] - at[:, 0]
                sequence[rows] = at[:, 2] + within // at[:, 1]
                offset[rows] = at[:, 3] + within % at[:, 1] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_rank").cast("long").alias("_rank")).mapInArrow(place, PACKED)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}
