"""Removal of repeated byte strings: suffixes on a difference cover are sorted by names, names decide which others are merged."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractionlens.llm.shared import byte_slices, table, word_spans, written, Hasher

MARKED = "sha string, n_removed long, n_spans long, kept_sha256 string, kept_text binary, byte_removed long, byte_spans long, byte_sha256 string"
SENT = "bucket int, slice int, hashes binary, twice binary"


@lru_cache
def difference_cover(most: int) -> tuple[int, np.ndarray]:
    """(modulus v of at most `most`, residues): any two numbers have a shift k < v that takes both to residues modulo v.

    The residues are a line of the projective plane over the integers modulo a prime q: q + 1 of v = q * q + q + 1, and
    every difference occurs once. Powers of t modulo a cubic run over the plane's points; a cubic is tried until they do."""
    for q in range(int(most**0.5), 1, -1):
        v = q * q + q + 1
        if v > most or any(q % d == 0 for d in range(2, q)):
            continue
        for a, b, c in product(range(q), repeat=3):
            x, line = (1, 0, 0), []
            for i in range(v):
                if x[2] == 0:
                    line.append(i)
                x = (x[2] * a % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * c) % q)
            if len(line) == q + 1 and len({(i - j) % v for i in line for j in line}) == v:
                return v, np.array(line)
    return 1, np.zeros(1, int)


class _Texts:
    """The texts of a slice as one sequence of bytes, or of words as hashes, in which strings of `length` are looked for.

    Sampled suffixes begin at the residues of a difference cover, counted from their text's start. Two equal strings of
    `length` have a sampled suffix at one shift in both, which goes on for `width` inside the strings."""

    def __init__(self, seq: np.ndarray, offs: np.ndarray, length: int):
        self.seq, self.offs, self.length = seq, offs, length
        self.modulus, self.residues = difference_cover(int(0.62 * length))
        self.width = length - self.modulus + 1
        self.long = np.diff(offs) >= length

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the sampled suffixes and the names (hashes) of their first `width`."""
        blocks = np.where(self.long, (np.diff(self.offs) - self.width) // self.modulus + 1, 0)
        text = np.repeat(np.arange(len(blocks)), blocks)
        block = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = ((self.offs[text] + block * self.modulus)[:, None] + self.residues[None, :]).ravel()
        at = at[at + self.width <= np.repeat(self.offs[text + 1], len(self.residues))]
        return at, Hasher(self.seq).of(at, at + self.width)

    def merged(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that have a repeated sampled one less than a modulus after their start, and hashes of their `length`."""
        inside = np.zeros(len(self.seq) + 1, np.int32)
        text = np.searchsorted(self.offs, repeated, side="right") - 1
        np.add.at(inside, np.maximum(repeated - self.modulus + 1, self.offs[text]), 1)
        np.add.at(inside, np.minimum(repeated, self.offs[text + 1] - self.length) + 1, -1)
        starts = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
        return starts, Hasher(self.seq, which=1).of(starts, starts + self.length)


class _Slice:
    """The distinct texts of a group, by hash: their bytes, and with `words` set also their words."""

    def __init__(self, table: pa.Table, length: int, words: int):
        table = table.combine_chunks().sort_by("sha")
        self.sha = table.column("sha").to_numpy(zero_copy_only=False)
        new = np.ones(len(self.sha), bool)
        new[1:] = self.sha[1:] != self.sha[:-1]
        self.sha, table = self.sha[new], table.filter(pa.array(new)).combine_chunks()
        _, _, self.buf, self.offs = next(byte_slices(table.to_batches()[0], "text", 1 << 62))
        self.kinds = [_Texts(self.buf, self.offs, length)]
        if words:
            self.heads, self.tails, counts = word_spans(self.buf, self.offs)
            self.kinds.append(_Texts(Hasher(self.buf).of(self.heads, self.tails), counts, words))

    def names(self) -> np.ndarray:
        self.at, names = zip(*(kind.sample() for kind in self.kinds))
        return np.concatenate(names)

    def merged(self, hit: np.ndarray) -> np.ndarray:
        """Hashes of the strings to compare, given which sampled suffixes have a repeated name."""
        cuts = np.cumsum([len(x) for x in self.at])[:-1]
        self.starts, hashes = zip(*(kind.merged(at[yes]) for kind, at, yes in zip(self.kinds, self.at, np.split(hit, cuts))))
        return np.concatenate(hashes)

    def covered(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes inside repeated strings of bytes; bytes inside those or inside repeated passages."""
        spans = [(self.starts[0], self.starts[0] + self.kinds[0].length)]
        if len(self.kinds) > 1:
            spans.append((self.heads[self.starts[1]], self.tails[self.starts[1] + self.kinds[1].length - 1]))
        cover, out = np.zeros(len(self.buf) + 1, np.int32), []
        for (starts, ends), yes in zip(spans, np.split(hit, [len(self.starts[0])])):
            np.add.at(cover, starts[yes], 1)
            np.add.at(cover, ends[yes], -1)
            out.append(np.cumsum(cover)[:-1] > 0)
        return out[0], out[-1]


class _Sorted:
    """Hashes in order, each once, dealt by range to buckets; a bucket answers which of them occur elsewhere too."""

    def __init__(self, hashes: np.ndarray, buckets: int):
        self.distinct, self.of = np.unique(hashes, return_inverse=True)
        self.edges = np.searchsorted(self.distinct // np.uint64(2**64 // buckets + 1), np.arange(buckets + 1, dtype=np.uint64))

    def sent(self, number: int, kind: type) -> pa.Table:
        twice = np.bincount(self.of, minlength=len(self.distinct)) > 1
        use = np.flatnonzero(np.diff(self.edges))
        parts = [slice(self.edges[b], self.edges[b + 1]) for b in use]
        return pa.table({
            "bucket": pa.array(use.astype(np.int32)),
            "slice": pa.array(np.full(len(use), number, np.int32)),
            "hashes": pa.array([self.distinct[p].astype(kind).tobytes() for p in parts], pa.binary()),
            "twice": pa.array([np.packbits(twice[p]).tobytes() for p in parts], pa.binary()),
        })

    def hits(self, answers: pa.Table) -> np.ndarray:
        hit = np.zeros(len(self.distinct), bool)
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("hit")):
            hit[self.edges[b] : self.edges[b + 1]] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=self.edges[b + 1] - self.edges[b])
        return hit[self.of]


def _met(sent: DataFrame, kind: type) -> DataFrame:
    """(slice, bucket, hit): each bucket sorts what all slices sent; adjacent equal ones, or one sent as found twice, are hits."""

    def meet(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), kind) for x in table.column("hashes")]
        n = [len(p) for p in parts]
        flags = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=k) for x, k in zip(table.column("twice"), n)])
        distinct, of = np.unique(np.concatenate(parts), return_inverse=True)
        seen = np.bincount(of, minlength=len(distinct)) + np.bincount(of, flags, len(distinct))
        hit = np.split((seen > 1)[of], np.cumsum(n)[:-1])
        return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "hit": pa.array([np.packbits(x).tobytes() for x in hit], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(meet, "slice int, bucket int, hit binary")


def repeated_strings(docs: DataFrame, length: int = 400, slice_bytes: int = 1 << 20, bucket_strings: int = 1_000_000, words: int = 0) -> DataFrame:
    """One row per document: doc_id, sha, n_bytes, n_removed, n_spans, kept_sha256, kept_text (binary, null if nothing goes).

    Texts are UTF-8 bytes; null is empty. Every byte that lies in a `length`-byte string that also starts elsewhere, in any
    document or the same one, is removed; strings are judged on the input. Texts shorter than `length` stay whole. Equal
    texts are one class: with two or more members of at least `length` bytes (or `words` words) all of their bytes go. Rows
    of one doc_id, or of none, are separate documents. An empty table gives no rows. Only doc_id and text are read. A text is
    worked on whole, with about 60 bytes of memory for each of its bytes.

    With `words` set, passages of that many words (runs of non-space, whatever white space lies between them) that also
    start elsewhere go too, from their first word's first byte to their last word's end, however few bytes they have.
    byte_removed, byte_spans and byte_sha256 then say what the strings of bytes alone remove.

    Distinct texts are dealt to slices of about `slice_bytes` by hash. A slice sends hashes, each once and in order, to
    buckets of about `bucket_strings` by range, so a string that a third of all documents share reaches its bucket once a slice.

    1. Sample: suffixes at the residues of a difference cover (14 of 183 bytes for 400) are sorted by the names of their
       first length - modulus + 1 bytes. Names of that width hold all that a repeated string has after its shift, so there is
       nothing left to recurse on. Names are hashes, so the order is theirs and not the alphabet's; within a bucket 32 bits
       tell them apart, and a false match only adds suffixes to the next step.
    2. Merge: the suffixes less than a modulus before a repeated sampled one are sorted by the 64-bit hash of `length` bytes.
    3. Adjacent prefixes that are equal are repeated strings; the slices mark their bytes."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("sha"), text.alias("text"))
    long = F.octet_length("text") >= length
    spoken = F.when(long, words).otherwise(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))) if words else F.lit(0)
    rows = written(base.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes"), (long | (spoken >= words if words else F.lit(False))).alias("sized")), "rows")
    total = rows.where("sized").agg(F.sum("n_bytes")).first()[0] or 0
    n_slices = max(1, -(-total // slice_bytes))
    buckets = max(12, total // (12 * bucket_strings))

    def distinct(batches):
        seen = set()
        for batch in batches:
            new = []
            for x in batch.column(1).to_pylist():
                new.append(x not in seen)
                seen.add(x)
            yield batch.filter(pa.array(new))

    least = min(length, 2 * words - 1) if words else length
    one = base.where(F.octet_length("text") >= least).select(F.pmod(F.xxhash64("sha"), F.lit(n_slices)).cast("int").alias("slice"), "sha", "text")
    sliced = one.mapInArrow(distinct, "slice int, sha string, text string").groupBy("slice")

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _Sorted(_Slice(table, length, words).names(), buckets).sent(key[0].as_py(), np.uint32)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Slice(table, length, words)
        return _Sorted(own.merged(_Sorted(own.names(), buckets).hits(answers)), buckets).sent(key[0].as_py(), np.uint64)

    def mark(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Slice(table, length, words)
        of = lambda k: answers.filter(pc.equal(answers.column("step"), k))
        strings = own.merged(_Sorted(own.names(), buckets).hits(of(1)))
        out: dict[str, list] = {name.split()[0]: [] for name in MARKED.split(", ")}
        gone = own.covered(_Sorted(strings, buckets).hits(of(2)))
        for sha, a, b in zip(own.sha, own.offs, own.offs[1:]):
            if not gone[1][a:b].any():
                continue
            out["sha"].append(sha)
            for of_all, part in ((False, gone[0][a:b]), (True, gone[1][a:b])):
                kept = own.buf[a:b][~part].tobytes()
                values = (int(part.sum()), int(part[:1].sum() + (part[1:] & ~part[:-1]).sum()), hashlib.sha256(kept).hexdigest())
                for name, value in zip(("n_removed", "n_spans", "kept_sha256") if of_all else ("byte_removed", "byte_spans", "byte_sha256"), values):
                    out[name].append(value)
            out["kept_text"].append(kept)
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return pa.table({name: pa.array(out[name], kinds[kind]) for name, kind in (x.split() for x in MARKED.split(", "))})

    names = _met(sliced.applyInArrow(send, SENT), np.uint32)
    strings = _met(sliced.cogroup(names.groupBy("slice")).applyInArrow(merge, SENT), np.uint64)
    answers = names.withColumn("step", F.lit(1)).union(strings.withColumn("step", F.lit(2)))
    marked = written(sliced.cogroup(answers.groupBy("slice")).applyInArrow(mark, MARKED), "marked")
    copies = rows.groupBy("sha").agg(F.count("*").alias("copies")).where("copies > 1")
    gone = F.col("copies").isNotNull() & F.col("sized")
    nothing = F.lit("").cast("binary")
    found = rows.join(copies, "sha", "left").join(marked, "sha", "left")
    whole = lambda removed, spans, sha: (
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce(removed, F.lit(0))).alias(removed),
        F.when(gone, 1).otherwise(F.coalesce(spans, F.lit(0))).cast("long").alias(spans),
        F.when(gone, F.sha2(nothing, 256)).otherwise(F.coalesce(sha, "sha")).alias(sha),
    )
    out = found.select("doc_id", "sha", "n_bytes", *whole("n_removed", "n_spans", "kept_sha256"), F.when(gone, nothing).otherwise(F.col("kept_text")).alias("kept_text"), *whole("byte_removed", "byte_spans", "byte_sha256"))
    return out if words else out.drop("byte_removed", "byte_spans", "byte_sha256")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns take strings of 400 bytes. n_cut counts the bytes in those or in repeated passages of over 50
    words, which may be shorter; cut says whether there are any."""
    out = repeated_strings(table(spark, sf_dir, "documents"), words=51)
    short = F.col("n_bytes") < 400  # equal texts of over 50 words and under 400 bytes hold no string of 400
    kept = lambda c, zero: F.when(short, zero).otherwise(F.col(c))
    digest = [kept("byte_removed", 0).cast("long").alias("n_removed"), kept("byte_spans", 0).cast("long").alias("n_spans"), kept("byte_sha256", F.col("sha")).alias("kept_sha256")]
    return out.select("doc_id", "n_bytes", *digest, F.col("n_removed").alias("n_cut"), (F.col("n_removed") > 0).alias("cut"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLES: dict[str, str] = {}
