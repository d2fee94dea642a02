"""Analysis operators: DataFrame -> DataFrame, each with `by` columns where the reference fans out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractionlens.functions import text as T


def _d(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def deviation(n: Column, total: Column, squares: Column) -> Column:
    """Population deviation from integer sums, so that no order of addition matters."""
    return F.sqrt((_d(n) * _d(squares) - _d(total) * _d(total)) / (_d(n) * _d(n)))


def counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by each key on its own, in one pass of grouping sets: (dimension, value, n)."""
    named = [F.coalesce(k, F.lit("unknown")).alias(k) for k in keys]
    out = df.select(*named).groupingSets([[k] for k in keys], *keys).agg(F.count("*").alias("n"), F.grouping_id(*keys).alias("g"))
    dimension = F.lit(None).cast("string")
    for i, k in enumerate(keys):
        dimension = F.when(F.col("g") == (2 ** len(keys) - 1 - 2 ** (len(keys) - 1 - i)), k).otherwise(dimension)
    return out.select(dimension.alias("dimension"), F.coalesce(*keys).alias("value"), "n")


def gaps(df: DataFrame, wanted: DataFrame, target: int) -> DataFrame:
    """Communities below `target` posts, those without posts included."""
    have = df.groupBy("subreddit").agg(F.count("*").alias("n"))
    out = wanted.select("subreddit").distinct().join(have, "subreddit", "left").select("subreddit", F.coalesce("n", F.lit(0)).alias("n"))
    return out.where(F.col("n") < target).withColumn("shortfall", target - F.col("n"))


def profile(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.min("upvotes").alias("min_upvotes"), F.max("upvotes").alias("max_upvotes"), F.avg("upvotes").alias("avg_upvotes"), F.date_format(F.min("created_utc"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("created_utc"), "yyyy-MM-dd").alias("last_day"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the extremes; equal extremes are widened by one half on both sides. Empty bins have no row."""
    v = df.where(F.col(value).isNotNull() & ~F.isnan(_d(value))).select(_d(value).alias("v"))
    edge = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    edge = edge.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    return v.crossJoin(F.broadcast(edge)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def inflections(hist: DataFrame, bins: int = 20) -> DataFrame:
    """Bins where the second difference of the counts changes its sign: the bin before the one whose count shows it."""
    w = W.orderBy("bin")
    full = hist.sparkSession.range(bins).select(F.col("id").alias("bin")).join(F.broadcast(hist), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    d = full.select("bin", (F.col("n") - 2 * F.lag("n").over(w) + F.lag("n", 2).over(w)).alias("d"))
    d = d.select("bin", F.signum(F.col("d").cast("double")).alias("s"), F.signum(F.lag("d").over(w).cast("double")).alias("p"))
    return d.where("s <> 0 AND p <> 0 AND s <> p").select((F.col("bin") - 1).alias("bin"))


def distribution(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    v = F.col(value)
    p = F.percentile(v, F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)]))
    out = df.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), deviation(F.count("*"), F.sum(v), F.sum(v * v)).alias("std"), p.alias("p"))
    return out.select(*by, "n", "mean", "std", *[F.col("p")[i].alias(f"p{x}") for i, x in enumerate((10, 25, 50, 75, 90, 95, 99))])


def pearson(df: DataFrame, x: str, y: str, by: list[str], least: int = 10, weight: str | None = None) -> DataFrame:
    """Pearson correlation from exact integer sums; under `least` pairs it is 0. `weight` counts how often a row occurs. Sums are
    decimals of 38 digits: n times the sum of squared ranks outgrows 64 bits from about 50,000 rows on."""
    wide = lambda k: F.col(k).cast("decimal(38,0)")
    a, b, w = wide(x), wide(y), wide(weight) if weight else F.lit(1).cast("decimal(38,0)")
    sums = {"n": w, "sx": w * a, "sy": w * b, "sxy": w * a * b, "sxx": w * a * a, "syy": w * b * b}
    s = df.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    s = s.withColumn("n", F.coalesce("n", F.lit(0)))
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    r = F.when((F.col("n") < least) | (vx <= 0) | (vy <= 0), 0.0).otherwise(_d(cov) / (F.sqrt(_d(vx)) * F.sqrt(_d(vy))))
    return s.select(*by, F.col("n").cast("long").alias("n"), F.coalesce(r, F.lit(0.0)).alias("r"))


def two_sided(z: Column) -> Column:
    """P(|Z| >= z) of a normal value, by a rational approximation of erfc with a relative error below 1.2e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    series = F.lit(0.17087277)
    for k in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        series = k + t * series
    return t * F.exp(series - x * x)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs: t with n - 2 degrees of freedom by its normal transform (error below 1e-3 of
    p from ten pairs on). 1 where r is 0, as for too few pairs."""
    dof = n - 2
    t2 = r * r * dof / F.greatest(1 - r * r, F.lit(1e-300))
    z = F.sqrt(dof * F.log1p(t2 / dof)) * (8 * dof + 1) / (8 * dof + 3)
    return F.when((n < 10) | (r == 0), 1.0).otherwise(two_sided(z))


def with_p(correlations: DataFrame) -> DataFrame:
    return correlations.withColumn("p", correlation_p(F.col("r"), F.col("n").cast("double")))


def ranks(df: DataFrame, value: str, by: list[str], weight: str) -> DataFrame:
    """Twice the average rank (an integer) of each distinct value; `weight` counts the rows that a row stands for."""
    c = df.groupBy(*by, value).agg(F.sum(weight).alias("_n"))
    below = F.sum("_n").over(W.partitionBy(*by).orderBy(value)) - F.col("_n")
    return c.select(*by, value, (2 * below + F.col("_n") + 1).alias(f"rank2_{value}"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson of ranks. Rows are counted by their pair of values first, so a value that most rows have is one row a pair."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("_w"))
    ranked = both.join(ranks(both, x, by, "_w"), [*by, x]).join(ranks(both, y, by, "_w"), [*by, y])
    return pearson(ranked, f"rank2_{x}", f"rank2_{y}", by, weight="_w")


def cohens_d(df: DataFrame, value: str, flag: Column, by: list[str]) -> DataFrame:
    v = F.col(value)
    s = df.select(*by, v.alias("v"), flag.alias("f")).groupBy(*by).agg(*[F.sum(F.when(F.col("f") == f, e)).alias(f"{n}{int(f)}") for f in (True, False) for n, e in (("n", F.lit(1)), ("s", F.col("v")), ("q", F.col("v") * F.col("v")))])
    var = lambda k: (_d(f"n{k}") * _d(f"q{k}") - _d(f"s{k}") * _d(f"s{k}")) / (_d(f"n{k}") * (_d(f"n{k}") - 1))
    ok = (F.coalesce("n1", F.lit(0)) >= 2) & (F.coalesce("n0", F.lit(0)) >= 2)
    s = s.select(*by, "*").withColumn("ok", ok).withColumn("v1", F.when(ok, var(1))).withColumn("v0", F.when(ok, var(0)))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
    mean = _d("s1") / _d("n1") - _d("s0") / _d("n0")
    return s.select(*by, F.when(~F.col("ok") | (pooled <= 0), 0.0).otherwise(mean / F.sqrt(pooled)).alias("d"))


def inliers(df: DataFrame, value: str, by: list[str], k: float = 1.5) -> DataFrame:
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    spread = (F.col("q")[1] - F.col("q")[0]) * k
    return df.join(q, by).where((F.col(value) >= F.col("q")[0] - spread) & (F.col(value) <= F.col("q")[1] + spread)).drop("q")


def optimal_range(df: DataFrame, metric: str, score: str, by: list[str], least: int = 5) -> DataFrame:
    """The window of max(least, a fifth) rows, by metric and post_id, with the highest mean score: (low, high). Under ten rows: 0, 0."""
    groups = df.groupBy(*by, metric).agg(F.count("*").alias("_n"), F.sum(score).alias("_s"))
    upto, all_ = W.partitionBy(*by).orderBy(metric), W.partitionBy(*by)
    groups = groups.select(*by, metric, (F.sum("_n").over(upto) - F.col("_n")).alias("_rows"), (F.sum("_s").over(upto) - F.col("_s")).alias("_score"), F.sum("_n").over(all_).alias("n"))
    # rows are numbered within one value of the metric; the values before it come from their counts
    w = W.partitionBy(*by, metric).orderBy("post_id")
    r = df.join(groups, [*by, metric]).select(*by, F.col(metric).alias("m"), (F.col("_rows") + F.row_number().over(w)).alias("i"), (F.col("_score") + F.sum(score).over(w.rowsBetween(W.unboundedPreceding, 0))).alias("c"), F.col(score).alias("u"), "n")
    r = r.withColumn("size", F.greatest(F.lit(least).cast("long"), F.floor(F.col("n") / 5)))
    right = r.select(*by, F.col("i").alias("j"), F.col("c").alias("c2"), F.col("m").alias("hi"))
    left = r.withColumn("j", F.col("i") + F.col("size") - 1).withColumn("before", F.col("c") - F.col("u"))
    win = left.join(right, [*by, "j"]).where(F.col("i") <= F.col("n") - F.col("size")).where(F.col("c2") - F.col("before") > 0)
    best = win.groupBy(*by).agg(F.max(F.struct((F.col("c2") - F.col("before")).alias("s"), (-F.col("i")).alias("k"), "m", "hi")).alias("b"))
    all_ = df.groupBy(*by).agg(F.count("*").alias("n"))
    return all_.join(best, by, "left").select(*by, F.when(F.col("n") >= 10, F.coalesce("b.m", F.lit(0))).otherwise(0).alias("low"), F.when(F.col("n") >= 10, F.coalesce("b.hi", F.lit(0))).otherwise(0).alias("high"))


def keywords(df: DataFrame, column: str, stop: tuple[str, ...], least: int, top: int, by: list[str]) -> DataFrame:
    words = df.select(*by, F.explode(F.regexp_extract_all(F.lower(column), F.lit("([a-z]{3,})"), F.lit(1))).alias("word")).where(~F.col("word").isin(*stop))
    c = words.groupBy(*by, "word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return c.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "word"))).where(F.col("rank") <= top)


def rates(df: DataFrame, flags: dict[str, Column], by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[(_d(F.count_if(c)) / _d(F.count("*"))).alias(k) for k, c in flags.items()])


def title_flags() -> dict[str, Column]:
    t, has = F.col("title"), lambda x: F.contains(F.col("title"), F.lit(x))
    return {"colon": has(":"), "dash": has("\u2014") | has(" - "), "parenthesis": has("("), "number": t.rlike(r"\p{Nd}"), "question": F.endswith(T.stripped(t), F.lit("?"))}


def template_flags() -> dict[str, Column]:
    """The slots of a structure template, in order; a question is told by the very last character."""
    t, has = F.col("title"), lambda x: F.contains(F.col("title"), F.lit(x))
    return {"colon": has(":"), "dash": has("\u2014") | has(" - "), "question": F.endswith(t, F.lit("?")), "number": t.rlike(r"\p{Nd}"), "bracket": has("[") | has("(")}


def body_flags() -> dict[str, Column]:
    b = F.col("body")
    return {
        "list": b.rlike(r"(?md)^[-*0-9+.][ \t\n\r\f\x0B]"),
        "tldr": b.rlike(r"(?i)\bTL[;:]?DR\b"),
        "bold": F.contains(b, F.lit("**")),
        "quote": F.startswith(b, F.lit(">")) | F.contains(b, F.lit("\n>")),
        "ending_question": F.endswith(T.stripped(b), F.lit("?")),
        "call_to_action": T.has_any(F.lower(b), T.CALLS),
    }


def class_stats(df: DataFrame, label: Column, name: str, by: list[str]) -> DataFrame:
    """Per class: n, total, average and population deviation of the score, share of the group's posts."""
    u = F.col("upvotes")
    g = df.select(*by, label.alias(name), u).groupBy(*by, name).agg(F.count("*").alias("n"), F.sum(u).alias("total"), F.avg(u).alias("avg_upvotes"), deviation(F.count("*"), F.sum(u), F.sum(u * u)).alias("std"))
    return g.withColumn("share", _d("n") / _d(F.sum("n").over(W.partitionBy(*by))))


def templates(df: DataFrame, top: int = 10, least: int = 5) -> DataFrame:
    """Combinations of a title's slots, absent ones empty: the `top` most frequent, then those with `least` titles."""
    key = F.concat_ws("|", *[F.when(c, k).otherwise("") for k, c in template_flags().items()])
    g = df.where("title <> ''").select(key.alias("template"), "upvotes").groupBy("template").agg(F.count("*").alias("n"), F.avg("upvotes").alias("avg_upvotes"))
    return g.orderBy(F.desc("n"), "template").limit(top).where(F.col("n") >= least)


def gain(df: DataFrame, test: Column) -> DataFrame:
    """Mean score with and without a property; 0 where one side is empty."""
    a = df.agg(_d(F.avg(test.cast("int"))).alias("rate"), F.avg(F.when(test, F.col("upvotes"))).alias("w"), F.avg(F.when(~test, F.col("upvotes"))).alias("o"))
    return a.select("rate", F.when(F.col("w").isNull() | F.col("o").isNull(), 0.0).otherwise(F.col("w") - F.col("o")).alias("gain"))


def cutoff(df: DataFrame, zero_based: bool) -> DataFrame:
    """One row: the score at rank max(1, n // 10), or at index n // 10. Scores are counted before they are ranked."""
    c = df.groupBy("upvotes").agg(F.count("*").alias("m"))
    total = df.agg(F.count("*").alias("n"))
    upto = F.sum("m").over(W.orderBy(F.desc("upvotes")))
    want = F.floor(F.col("n") / 10) + 1 if zero_based else F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / 10))
    return c.withColumn("upto", upto).crossJoin(total).where(F.col("upto") >= want).agg(F.max("upvotes").alias("cutoff"))


def slot_stats(df: DataFrame, slot: Column, slots: DataFrame, name: str) -> DataFrame:
    """Every slot, with count, average and share of posts at or above the top-decile score of the posts with a time."""
    dated = df.where("created_utc IS NOT NULL")
    cut = cutoff(dated, False)
    g = dated.crossJoin(F.broadcast(cut)).groupBy(slot.alias(name)).agg(F.count("*").alias("n"), F.avg("upvotes").alias("avg_upvotes"), F.count_if(F.col("upvotes") >= F.col("cutoff")).alias("tops"))
    return slots.join(F.broadcast(g), name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("avg_upvotes", F.lit(0.0)).alias("avg_upvotes"), F.coalesce(_d("tops") / _d("n"), F.lit(0.0)).alias("top_share"))


def time_matrix(df: DataFrame) -> DataFrame:
    """Per slot such as Mon_07: count, average, median, and the median against that of all posts with a time (at least 1)."""
    dated = df.where("created_utc IS NOT NULL")
    whole = dated.agg(F.greatest(F.median("upvotes"), F.lit(1.0)).alias("g"))
    slots = dated.groupBy(F.date_format("created_utc", "E_HH").alias("slot")).agg(F.count("*").alias("n"), F.avg("upvotes").alias("avg_upvotes"), F.median("upvotes").alias("median"))
    return slots.crossJoin(F.broadcast(whole)).select("slot", "n", "avg_upvotes", "median", (F.col("median") / F.col("g")).alias("lift"))


def flairs(df: DataFrame) -> DataFrame:
    """Per flair (lower-cased; an empty one is none) the statistics of its posts, and the share of all posts that have one."""
    some = F.coalesce(F.col("flair") != "", F.lit(False))
    rate = df.agg((_d(F.count_if(some)) / _d(F.count("*"))).alias("flair_rate"))
    return class_stats(df.where(some), F.lower("flair"), "flair", []).crossJoin(F.broadcast(rate))


def preferences(df: DataFrame) -> DataFrame:
    tw, bw = T.n_words(F.col("title")), F.when(F.length("body") > 0, T.n_words(F.col("body")))
    q = F.array(F.lit(0.25), F.lit(0.75))
    g = df.groupBy("subreddit").agg(F.percentile(tw, q).alias("t"), F.percentile(bw, q).alias("b"), F.median("upvotes").alias("median"), F.count("*").alias("n"))
    return g.select("subreddit", *[F.floor(F.col(c)[i]).alias(f"{k}_{e}") for c, k in (("t", "title_words"), ("b", "body_words")) for i, e in ((0, "low"), (1, "high"))], "median", "n")


def specificity(df: DataFrame, least: int = 20) -> DataFrame:
    """Mean relative deviation of a community's median title and body words from the global ones, at most 1. Empty titles and
    bodies don't count; a median of none is 0."""
    words = lambda c: F.coalesce(F.median(F.when(F.col(c) != "", T.n_words(F.col(c)))), F.lit(0.0))
    whole = df.agg(words("title").alias("ga"), words("body").alias("gb"))
    g = df.groupBy("subreddit").agg(F.count("*").alias("n"), words("title").alias("a"), words("body").alias("b")).where(F.col("n") >= least).crossJoin(F.broadcast(whole))
    rel = lambda x, y: F.abs(F.col(x) - F.col(y)) / F.greatest(F.col(y), F.lit(1.0))
    return g.select("subreddit", F.least((rel("a", "ga") + rel("b", "gb")) / 2, F.lit(1.0)).alias("score"))


def velocity(df: DataFrame, as_of: str) -> Column:
    hours = (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("created_utc")) / 3600
    return F.col("upvotes") / F.greatest(hours, F.lit(1.0))


def velocity_profile(df: DataFrame, as_of: str) -> DataFrame:
    """One row over the posts with a time: n, Pearson's r of velocity and score, and the 20th percentile of the velocity among
    posts at or above the top-decile score."""
    dated = df.where("created_utc IS NOT NULL").withColumn("v", velocity(df, as_of))
    top = dated.crossJoin(F.broadcast(cutoff(dated, False))).agg(F.percentile(F.when(F.col("upvotes") >= F.col("cutoff"), F.col("v")), F.lit(0.2)).alias("threshold"))
    r = dated.agg(F.count("*").alias("n"), F.corr("v", _d("upvotes")).alias("r")).select("n", F.when(F.col("n") < 10, 0.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("r"))
    return r.crossJoin(top).select("n", "r", F.coalesce("threshold", F.lit(0.0)).alias("threshold"))


GROWTH = ("logarithmic", "exponential", "impulsive", "linear", "bimodal", "unknown")


def growth_classes(df: DataFrame, as_of: str) -> DataFrame:
    """Posts by growth class, all classes listed, with their share. Without a score above 0 or a time a post is unknown."""
    u, ratio = F.col("upvotes"), F.col("num_comments") / F.greatest(F.col("upvotes"), F.lit(1))
    label = F.when((u <= 0) | u.isNull() | F.col("created_utc").isNull(), "unknown").when(velocity(df, as_of) > 100, "exponential")
    label = label.when((ratio > 1.5) & (u > 100), "impulsive").when((ratio > 0.5) & (u > 500), "bimodal").when((ratio > 0.05) & (ratio < 0.5), "linear").otherwise("logarithmic")
    names = df.sparkSession.createDataFrame([(x,) for x in GROWTH], "growth string")
    g = df.groupBy(label.alias("growth")).agg(F.count("*").alias("n"))
    out = names.join(F.broadcast(g), "growth", "left").select("growth", F.coalesce("n", F.lit(0)).alias("n"))
    total = out.agg(F.greatest(F.sum("n"), F.lit(1).cast("long")).alias("total"))
    return out.crossJoin(F.broadcast(total)).select("growth", "n", (_d("n") / _d("total")).alias("share"))


def controversy(df: DataFrame) -> DataFrame:
    """One row on posts that few like and some discuss; means of none are 0."""
    c = df.where("upvote_ratio > 0 AND upvote_ratio < 0.75 AND num_comments > 0")
    measures = {
        "avg_upvotes": F.avg("upvotes"),
        "avg_comments": F.avg("num_comments"),
        "median_upvote_ratio": F.median("upvote_ratio"),
        "flair_usage": F.avg(F.coalesce(F.col("flair") != "", F.lit(False)).cast("double")),
        "engagement_per_upvote": F.avg(F.col("num_comments") / F.greatest(F.col("upvotes"), F.lit(1))),
    }
    return c.agg(F.count("*").alias("n"), *[F.coalesce(m, F.lit(0.0)).alias(k) for k, m in measures.items()])


def media_stats(df: DataFrame) -> DataFrame:
    """Per media type: the statistics of its posts, and the share of them at or above the score at index n // 10 from the top."""
    cut = cutoff(df, True)
    top = df.crossJoin(F.broadcast(cut)).groupBy(F.col("content_type").alias("media")).agg((_d(F.count_if(F.col("upvotes") >= F.col("cutoff"))) / _d(F.count("*"))).alias("top_share"))
    return class_stats(df, F.col("content_type"), "media", []).join(F.broadcast(top), "media")


def dominant_media(df: DataFrame) -> DataFrame:
    """Per community: its most frequent media type, that type's share, and posts by type."""
    g = df.groupBy("subreddit", "content_type").agg(F.count("*").alias("n"))
    best = g.groupBy("subreddit").agg(F.max(F.struct("n", "content_type")).alias("b"), F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("content_type", "n")))).alias("distribution"))
    return best.select("subreddit", F.col("b.content_type").alias("dominant"), (_d("b.n") / _d("total")).alias("share"), "distribution")


def media_return(df: DataFrame, base: str = "text", others: tuple[str, ...] = ("image", "video")) -> DataFrame:
    """Text against other media: averages of each, and for the others the average score against that of `base` (at least 1)."""
    text = df.agg(F.greatest(F.avg(F.when(F.col("content_type") == base, F.col("upvotes"))), F.lit(1.0)).alias("base"), F.count_if(F.col("content_type") == base).alias("k"))
    g = df.where(F.col("content_type").isin(base, *others)).groupBy("content_type").agg(F.count("*").alias("n"), F.avg("upvotes").alias("avg_upvotes"), F.avg("num_comments").alias("avg_comments"), F.avg("upvote_ratio").alias("avg_ratio"))
    boost = F.when((F.col("content_type") != base) & (F.col("k") > 0), F.col("avg_upvotes") / F.col("base"))
    return g.crossJoin(F.broadcast(text)).select("content_type", "n", "avg_upvotes", "avg_comments", "avg_ratio", boost.alias("boost"))


def crossrefs(docs: DataFrame) -> DataFrame:
    """Equal texts in several communities: (source community, smallest post)."""
    first = docs.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.min("doc_id").alias("target"), F.countDistinct("source").alias("k")).where("k > 1").drop("k")
    return docs.withColumn("h", F.xxhash64("text")).join(first, ["h", "text"]).where("doc_id <> target").select(F.col("source").alias("source_subreddit"), F.concat(F.lit("t3_"), F.col("target").cast("string")).alias("target_post_id"))


def propagation(refs: DataFrame, df: DataFrame, top: int = 20) -> DataFrame:
    edges = refs.join(df.select(F.col("post_id").alias("target_post_id"), F.col("subreddit").alias("target")), "target_post_id").groupBy("source_subreddit", "target").agg(F.count("*").alias("n"))
    share = _d("n") / _d(F.sum("n").over(W.partitionBy("source_subreddit")))
    return edges.withColumn("share", share).orderBy(F.desc("n"), "source_subreddit", "target").limit(top)


def spread(df: DataFrame, refs: DataFrame) -> DataFrame:
    hit = refs.select(F.col("target_post_id").alias("post_id")).distinct().withColumn("hit", F.lit(1))
    return df.join(hit, "post_id", "left").groupBy("content_type").agg(F.count("*").alias("n"), (_d(F.count("hit")) / _d(F.count("*"))).alias("spread"))


def latest(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key, the first in `order`; a null key keeps all its rows, which take no part in the window."""
    r = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.where(F.col(key).isNotNull()).withColumn("_r", r).where(F.col("_r") == 1).drop("_r").union(df.where(F.col(key).isNull()))


def top_per(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def image_titles(df: DataFrame) -> DataFrame:
    """Titles of image posts, and the share of them at or above the mean score of all posts."""
    whole = df.agg(F.avg("upvotes").alias("mean"))
    g = df.where("content_type = 'image'").crossJoin(F.broadcast(whole))
    share = lambda test: _d(F.count_if(test)) / _d(F.count("*"))
    t = F.col("title")
    return g.agg(F.count("*").alias("n"), F.avg(T.n_words(t)).alias("title_words"), share(t.rlike("[0-9]")).alias("number_rate"), share(F.endswith(F.trim(t), F.lit("?"))).alias("question_rate"), F.avg("upvotes").alias("avg_upvotes"), share(F.col("upvotes") >= F.col("mean")).alias("above_mean"))


def community_profiles(df: DataFrame, least: int = 20) -> DataFrame:
    """Communities with `least` posts: the upper median (row n / 2 from below), the top-decile line (row n / 10 from above),
    mean title words, the dominant media. Scores are counted before they are ranked."""
    c = df.groupBy("subreddit", "upvotes").agg(F.count("*").alias("k"))
    up, all_ = W.partitionBy("subreddit").orderBy("upvotes"), W.partitionBy("subreddit")
    c = c.select("subreddit", "upvotes", F.sum("k").over(up).alias("upto"), "k", F.sum("k").over(all_).alias("n"))
    from_top = F.col("n") - F.col("upto") + F.col("k")
    lines = c.where(F.col("n") >= least).groupBy("subreddit", "n").agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("upvotes"))).alias("median"), F.max(F.when(from_top > F.floor(F.col("n") / 10), F.col("upvotes"))).alias("top_line"))
    words = df.where("title <> ''").groupBy("subreddit").agg(F.avg(T.n_words(F.col("title"))).alias("title_words"))
    return lines.join(words, "subreddit", "left").join(dominant_media(df).drop("distribution"), "subreddit").select("subreddit", "n", "median", "top_line", "title_words", "dominant", "share")
