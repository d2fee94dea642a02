"""Language identification: an interpolated Kneser-Ney character model per language, kept in sorted hash arrays."""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractionlens.llm.shared import mix, table

PREDICTED = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"
_EDGE = np.uint32(0)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "L"]] = True
        _LETTERS.append(table)
    return _LETTERS[0]


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the lower-cased texts, start and end of each run of letters, and the text of each run."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = np.cumsum([len(t) + 1 for t in lowered])
    flags = np.diff(np.concatenate([[0], _letters()[codes].astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(flags == 1), np.flatnonzero(flags == -1)
    return codes, starts, ends, np.searchsorted(cuts, starts, side="right")


def _padded(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word with an edge mark on both sides, one after another, and the word of each symbol."""
    n = ends - starts + 2
    word = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    inner = (at > 0) & (at < n[word] - 1)
    out = np.full(len(word), _EDGE)
    out[inner] = codes[(starts[word] + at - 1)[inner]]
    return out, word


def _grams(symbols: np.ndarray, word: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1..order: (positions that have n symbols of their word up to them, hash of the n-gram, hash of its history)."""
    base = mix(symbols.astype(np.uint64) + np.uint64(7))
    out, whole, history = [], np.zeros(len(symbols), np.uint64), None
    keep = np.arange(len(symbols))
    for n in range(1, order + 1):
        keep = keep[keep >= n - 1]
        keep = keep[word[keep] == word[keep - (n - 1)]]
        whole = np.zeros(len(keep), np.uint64)
        history = np.zeros(len(keep), np.uint64)
        for j in range(n):  # left to right
            code = base[keep - (n - 1) + j]
            if j == n - 1:
                history = whole
            whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + code)
        out.append((keep, whole, history))
    return out


class Model(NamedTuple):
    """Per order: sorted hashes of n-grams with log probability, sorted hashes of histories with log back-off weight."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    histories: list[tuple[np.ndarray, np.ndarray]]
    unseen: float


def train(texts: list[str], order: int = 5, discount: float = 0.75) -> Model:
    """Interpolated Kneser-Ney: raw counts at the highest order and for histories at a word's start, else continuation counts."""
    codes, starts, ends, _ = letter_words(texts)
    symbols, word = _padded(codes, starts, ends)
    levels = _grams(symbols, word, order)
    first = np.concatenate([[True], word[1:] != word[:-1]]) if len(word) else np.zeros(0, bool)
    grams, histories, lower = [], [], None
    unseen = 1.0 / (len(np.unique(symbols)) + 2)
    for n, (keep, whole, history) in enumerate(levels, 1):
        predicted = ~first[keep]  # the opening mark is never predicted
        if n < order:
            # distinct longer n-grams that end in this one; those that begin a word cannot be longer
            upper_keep, upper, _ = levels[n]
            _, one = np.unique(upper, return_index=True)
            pos = upper_keep[one]
            at_start = keep[first[keep - (n - 1)] & predicted]
            slot = np.concatenate([pos[~first[pos]], at_start])
            index = np.searchsorted(keep, slot)
            sample, hist, where = whole[index], history[index], keep[index]
        else:
            sample, hist, where = whole[predicted], history[predicted], keep[predicted]
        keys, at, count = np.unique(sample, return_index=True, return_counts=True)
        if not len(keys):
            grams.append((keys, np.zeros(0)))
            histories.append((keys, np.zeros(0)))
            continue
        h_keys, h_of = np.unique(hist[at], return_inverse=True)
        total, kinds = np.bincount(h_of, count), np.bincount(h_of)
        gamma = discount * kinds / total
        if n == 1:
            below = np.full(len(keys), unseen)
        else:
            prev_keep, prev_whole, _ = levels[n - 2]
            prev_hash = prev_whole[np.searchsorted(prev_keep, where[at])]
            below = np.exp(_lookup(lower, prev_hash, np.log(unseen))[0])
        p = np.maximum(count - discount, 0) / total[h_of] + gamma[h_of] * below
        lower = (keys, np.log(p))
        grams.append(lower)
        histories.append((h_keys, np.log(gamma)))
    return Model(grams, histories, float(np.log(unseen)))


def _lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
    hashes, values = table
    if not len(hashes):
        return np.full(len(keys), missing), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    found = hashes[at] == keys
    return np.where(found, values[at], missing), found


def word_costs(models: list[Model], symbols: np.ndarray, word: np.ndarray, levels, n_words: int) -> list[np.ndarray]:
    """For each model, the negative log probability of each word, its closing mark included.

    The distinct hashes of a level are sorted once for all models: sorted keys are found much faster than scattered ones."""
    known = [np.full(len(symbols), m.unseen) for m in models]
    for n, (keep, whole, history) in enumerate(levels):  # from short to long histories: the longest known one stays
        grams, gram_of = np.unique(whole, return_inverse=True)
        before, before_of = np.unique(history, return_inverse=True)
        for model, cost in zip(models, known):
            value, found = _lookup(model.grams[n], grams, 0.0)
            weight, _ = _lookup(model.histories[n], before, 0.0)
            cost[keep] = np.where(found[gram_of], value[gram_of], cost[keep] + weight[before_of])
    first = np.concatenate([[True], word[1:] != word[:-1]]) if len(word) else np.zeros(0, bool)
    for cost in known:
        cost[first] = 0
    return [-np.bincount(word, cost, n_words) for cost in known]


def costs(models: list[Model], texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages: summed cost, texts: predicted symbols). Each distinct word of the call is scored once."""
    codes, starts, ends, owner = letter_words(texts)
    if not len(starts):
        return np.zeros((len(texts), len(models))), np.zeros(len(texts))
    sums = np.zeros(len(codes) + 1, np.uint64)
    up = np.cumprod(np.full(len(codes), 0x9E3779B97F4A7C15, np.uint64))
    down = np.cumprod(np.full(len(codes), pow(0x9E3779B97F4A7C15, -1, 2**64), np.uint64))
    np.cumsum(mix(codes.astype(np.uint64)) * up, out=sums[1:])
    key = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    _, one, of = np.unique(key, return_index=True, return_inverse=True)
    symbols, word = _padded(codes, starts[one], ends[one])
    levels = _grams(symbols, word, order)
    pairs = np.stack([np.bincount(owner, c[of], len(texts)) for c in word_costs(models, symbols, word, levels, len(one))], axis=1)
    return pairs, np.bincount(owner, ends - starts + 1, len(texts)).astype(float)


class Identifier(NamedTuple):
    langs: list[str]
    models: list[Model]
    order: int
    scale: float
    limit: float

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language index (-1: no letter), score, cross-entropy of the best, rejected."""
        total, n = costs(self.models, texts, self.order)
        rate = total / np.maximum(n, 1)[:, None]
        logit = -rate * self.scale * np.sqrt(np.maximum(n, 1))[:, None]
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = rate.argmin(1)
        rows = np.arange(len(texts))
        none = n == 0
        # short texts vary more: the limit is widened by their length
        rejected = none | (rate[rows, best] > self.limit * (1 + 2 / np.sqrt(np.maximum(n, 1))))
        return np.where(none, -1, best), np.where(none, 0.0, p[rows, best]), np.where(none, 0.0, rate[rows, best]), rejected


def fit(rows: list[tuple[str, str]], order: int) -> Identifier:
    """Models from three quarters of the rows; the scale of the scores and the rejection limit from the last quarter."""
    langs = sorted({lang for lang, _ in rows})
    by = {lang: [t for x, t in rows if x == lang] for lang in langs}
    models = [train(by[x][: max(1, len(by[x]) * 3 // 4)], order) for x in langs]
    held = [(i, t) for i, x in enumerate(langs) for t in by[x][len(by[x]) * 3 // 4 :]]
    total, n = costs(models, [t for _, t in held], order)
    use = n > 0
    truth = np.array([i for i, _ in held])[use]
    if not len(truth):
        return Identifier(langs, models, order, 1.0, np.inf)
    rate, n = total[use] / n[use][:, None], n[use]
    right = rate[np.arange(len(truth)), truth]
    limit = float(np.quantile(right, 0.99) * 1.25)

    def loss(scale: float) -> float:
        z = -rate * scale * np.sqrt(n)[:, None]
        z -= z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth]))

    return Identifier(langs, models, order, min((0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4), key=loss), limit)


def chosen(training: DataFrame, per_lang: int, ranges: int = 1024) -> DataFrame:
    """(lang, _h, text) of at most `per_lang` texts of each language: those with the smallest hashes of doc_id and text.

    Counts by range of the hash say how far each language has to be read, so no task ranks all rows of one language; equal
    rows count once. The keys of the chosen rows, a bounded number a language, then meet the texts."""
    pick = training.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", F.xxhash64("doc_id", "text").alias("_h"), "text")
    keys = pick.select("lang", "_h", F.floor(F.shiftrightunsigned("_h", 1) / (2**63 // ranges)).alias("_b"))
    upto = F.sum("_n").over(W.partitionBy("lang").orderBy("_b")) - F.col("_n")
    near = keys.groupBy("lang", "_b").agg(F.count("*").alias("_n")).withColumn("_n", upto).where(F.col("_n") < per_lang).select("lang", "_b")
    first = keys.join(F.broadcast(near), ["lang", "_b"]).select("lang", "_h").distinct()
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.shiftrightunsigned("_h", 1), "_h"))
    first = first.withColumn("_r", rank).where(F.col("_r") <= per_lang).drop("_r")
    return pick.join(F.broadcast(first), ["lang", "_h"]).dropDuplicates(["lang", "_h"])


def identify(docs: DataFrame, training: DataFrame, per_lang: int = 400, order: int = 5) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, cross_entropy (nats a character), rejected.

    Null text or text without a letter: lang_pred 'und', score 0, rejected. Rows repeat as in the input; columns other than
    doc_id and text are not read. Without training rows every text is 'und'. The models are fitted on at most `per_lang`
    whole texts of each language (the smallest hashes of doc_id and text, equal rows once), which bounds what is sent to the
    tasks. Languages that fit equally well: the first by name. An empty table gives no rows. Texts are read in runs of about
    2 million characters; a longer one is a run of its own."""
    rows = [(r["lang"], r["text"]) for r in chosen(training, per_lang).orderBy("lang", "_h", "text").collect()]
    model = fit(rows, order) if rows else None

    def predict(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, first = batch.column(0), 0
            while first < len(texts):
                end, size = first, 0
                while end < len(texts) and (end == first or size + len(texts[end]) <= 2_000_000):
                    size += len(texts[end])
                    end += 1
                part = texts[first:end]
                if model is None:
                    best, score, rate, rejected = np.full(len(part), -1), np.zeros(len(part)), np.zeros(len(part)), np.ones(len(part), bool)
                else:
                    best, score, rate, rejected = model.predict(part)
                names = np.array([*(model.langs if model else []), "und"], object)[best]
                yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), pa.array(names, pa.string()), pa.array(score), pa.array(rate), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])
                first = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, PREDICTED)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    out = identify(docs, docs.where(third != 1))
    return out.withColumn("held_out", F.coalesce(third == 1, F.lit(False)))


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
