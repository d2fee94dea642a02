"""What the operators of this subpackage share: shared storage, byte-level numpy text helpers, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"([^\x20\x09-\x0D]+)"
_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one temporary folder in a local session and an error on a
    cluster, whose executors share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="spark-"))
    return _FALLBACK[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, read again: later stages survive the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of `sf_dir`. One that fills fewer partitions than there are cores (a small file of one row group) is dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def numbered(nodes: DataFrame, order: list[str], grp: str = "grp") -> DataFrame:
    """`nodes` with pos, the place in the group by `order` from 0, and total, the nodes of the group.

    Rows are sorted in ranges of (`grp`, order), so a group of any size is spread over many tasks; what a range holds of a group
    is numbered by the counts of the ranges before it."""
    ranged = nodes.repartitionByRange(grp, *order).sortWithinPartitions(grp, *order)
    n = F.monotonically_increasing_id()
    ranged = written(ranged.withColumns({"_part": F.shiftright(n, 33), "_row": n.bitwiseAND(F.lit((1 << 33) - 1))}), "ranged")
    parts = ranged.groupBy(grp, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    whole = W.partitionBy(grp)
    parts = parts.select(grp, "_part", (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total"))
    return ranged.join(parts, [grp, "_part"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def words(text: Column) -> Column:
    """The words of a text; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(1))


# ---------------------------------------------------------------- bytes of Arrow batches

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_TABLES = [np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) for seed in (11, 29)]
_LOWER_TABLES = [t[_LOWER] for t in _TABLES]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values, so that every bit is usable."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 20)
        base = _BASES[which]
        have = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (base, pow(base, -1, 2**64)))
        _POWERS[which] = have
    return have


class Hasher:
    """Polynomial hashes of any part of one buffer of bytes (or of 64-bit hashes), in constant time each."""

    def __init__(self, buf: np.ndarray, lower: bool = False, which: int = 0):
        up, self.down = _powers(len(buf) + 1, which)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        values = buf if buf.dtype == np.uint64 else (_LOWER_TABLES if lower else _TABLES)[which][buf]
        np.cumsum(values * up[: len(buf)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `limit` bytes; a longer text is a run of its own. Null is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1)
        end = min(end, len(texts))
        yield first, end, data[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


def word_spans(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of words before it (one more entry than texts). `gap` has
    the bytes that lie between words."""
    inside = ~gap[buf]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offs[:-1] < offs[1:]
    heads, tails = offs[:-1][full], offs[1:][full] - 1
    start[heads], end[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def trimmed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without ASCII punctuation at their ends; one byte of a word always stays."""
    while len(starts) and (cut := _EDGE[buf[ends - 1]] & (ends - starts > 1)).any():
        ends = ends - cut
    while len(starts) and (cut := _EDGE[buf[starts]] & (ends - starts > 1)).any():
        starts = starts + cut
    return starts, ends


_COEFFICIENTS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and the text of each. A text of one to k - 1 words has its whole sequence as one window."""
    n = np.diff(counts)
    owner = np.repeat(np.arange(len(n)), n)
    m = max(0, len(hashes) - k + 1)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out += hashes[j : j + m] * _COEFFICIENTS[j]
    whole = owner[:m] == owner[k - 1 : k - 1 + m] if m else np.zeros(0, bool)
    out, doc = mix(out[whole]), owner[:m][whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.array([np.sum(hashes[counts[i] : counts[i + 1]] * _COEFFICIENTS[: n[i]], dtype=np.uint64) for i in short], np.uint64)
        extra += _COEFFICIENTS[40 + n[short] % 20]
        out, doc = np.concatenate([out, mix(extra)]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc


# ---------------------------------------------------------------- components


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable over undirected links, for every id that has one.

    Each round joins every node to the smallest label among its neighbours and then to the label of its label, so the
    number of rounds grows with the logarithm of a component's diameter. Rounds are written to the shared folder. A hub
    only receives partial minima, so a hot node does not gather its links in one task."""
    spark = links.sparkSession
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = written(both.union(both.select("y", "x")).distinct(), "edges")
    labels = edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("c")).select(F.col("x").alias("id"), F.col("c"))
    labels = written(labels, "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.min("c").alias("m"))
        step = labels.join(near, labels.id == near.x).select("id", F.least("c", "m").alias("n"), F.col("c").alias("old"))
        # hook: the root of the old label takes the smallest label that any of its nodes has seen
        hooks = step.groupBy(F.col("old").alias("r")).agg(F.min("n").alias("h"))
        step = step.join(hooks, step.old == hooks.r).select("id", F.least("n", "h").alias("n"), "old")
        jump = step.select(F.col("id").alias("k"), F.col("n").alias("j"))
        step = step.join(jump, step.n == jump.k).select("id", F.least("n", "j").alias("c"), "old")
        step = written(step, "labels")
        changed = step.where("c <> old").limit(1).count()
        labels = step.select("id", "c")
        if not changed:
            return labels.withColumnRenamed("c", "component")
