"""Intervals by resampling without resampled rows: weights of distinct values, exact quantiles of counts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractionlens.functions import special as Z


def mean_of(values: np.ndarray, weights: np.ndarray) -> float:
    return float(weights @ values / weights.sum())


def median_of(values: np.ndarray, weights: np.ndarray) -> float:
    """The median of values that come in order, each as often as its weight says."""
    upto, half = np.cumsum(weights), weights.sum() / 2
    return float(values[np.searchsorted(upto, half)] + values[np.searchsorted(upto, half, side="right")]) / 2


def poisson_quantiles(u: np.ndarray, k: int) -> np.ndarray:
    """For each u the smallest w with P(W <= w) >= u, W Poisson with mean k."""
    half = 12 * math.sqrt(k) + 40
    w = np.arange(max(0, int(k - half)), int(k + half) + 1)
    upto = np.cumsum(np.exp(w * math.log(k) - k - np.array([math.lgamma(x + 1) for x in w])))
    return w[np.minimum(np.searchsorted(upto, u), len(w) - 1)]


def _uniform(*parts: object) -> float:
    """52 bits of a hash as a number from 0 on below 1."""
    return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def bootstrap(df: DataFrame, value: str, by: str, statistic: Callable[[np.ndarray, np.ndarray], float] = mean_of, draws: int = 10_000, ci: float = 0.95, seed: int = 42, block: int = 250) -> DataFrame:
    """Per group: n, lower, middle (the draws' mean) and upper end of the interval of `statistic` (values, weights) -> number.

    A Poisson bootstrap: a row's weight in a draw is Poisson with mean 1, so a value that k rows hold has weight Poisson with
    mean k, taken from a hash of (seed, group, value, draw). Draws thus work on distinct values (integers) and their counts, no row
    is repeated, and any plan gives the same result. Blocks of `block` draws are tasks of their own; each gets a group's
    distinct values, which `statistic` needs together. A draw with no weight at all is left out. Nulls don't count; a group
    without values has no row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_g"), F.col(value).cast("long").alias("v")).agg(F.count("*").alias("k"))
    dealt = counts.select("_g", "v", "k", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // block))).alias("b"))

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        group, b = frame["_g"].iloc[0], int(frame["b"].iloc[0])
        frame = frame.sort_values("v")
        values, numbers = frame["v"].to_numpy(), np.arange(b * block, min(draws, (b + 1) * block))
        weights = np.stack([poisson_quantiles(np.array([_uniform(seed, group, v, i) for i in numbers]), int(k)) for v, k in zip(values, frame["k"])])
        found = [statistic(values, w) for w in weights.T if w.any()]
        return pd.DataFrame({"_g": [group] * len(found), "s": found})

    kind = df.schema[by].dataType.simpleString()
    found = dealt.groupBy("_g", "b").applyInPandas(draw, f"_g {kind}, s double")
    edge = (1 - ci) / 2
    q = found.groupBy("_g").agg(F.percentile("s", F.array(F.lit(edge), F.lit(1 - edge))).alias("q"), F.avg("s").alias("middle"))
    n = counts.groupBy("_g").agg(F.sum("k").alias("n"))
    return n.join(q, "_g").select(F.col("_g").alias(by), "n", F.col("q")[0].alias("lower"), "middle", F.col("q")[1].alias("upper"))


def null_interval(clusters: DataFrame, level: float = 0.95) -> DataFrame:
    """clusters (viral, n, ...) with null_lower and null_upper: between which a cluster of n posts drawn from all posts has its
    share of viral posts with chance `level`. Exact binomial quantiles of (n, share of all), where others draw samples."""
    whole = clusters.agg((F.sum("viral").cast("double") / F.sum("n").cast("double")).alias("_p"))
    edge = (1 - level) / 2
    out = clusters.crossJoin(F.broadcast(whole))
    at = lambda q: Z.binomial_at(q, F.col("n"), F.col("_p")).cast("double") / F.col("n")
    return out.withColumns({"null_lower": at(edge), "null_upper": at(1 - edge)}).drop("_p")
