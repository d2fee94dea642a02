"""Pattern mining, matching and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractionlens.functions import text as T


def features(df: DataFrame) -> DataFrame:
    return df.withColumns({"hook": T.hook_type(F.col("title")), "narrative": T.narrative_mode(F.col("body")), "title_words": T.n_words(F.col("title")), "body_words": T.n_words(F.col("body"))})


def viral_threshold(df: DataFrame, percentile: float, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile("upvotes", F.lit(percentile)).alias("threshold"))


def clusters(df: DataFrame, percentile: float = 0.9) -> DataFrame:
    """Per (tier, hook, narrative, media): viral posts, posts, rate, average. `df` has features()."""
    t = viral_threshold(df, percentile, [])
    g = df.crossJoin(F.broadcast(t)).groupBy("tier", "hook", "narrative", "content_type")
    g = g.agg(F.count_if(F.col("upvotes") >= F.col("threshold")).alias("viral"), F.count("*").alias("n"), F.avg("upvotes").alias("avg_upvotes"))
    return g.withColumn("rate", F.col("viral").cast("double") / F.col("n").cast("double"))


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Yates-corrected statistic of the table [[a, b], [c, d]]; 0 for an empty margin."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    gap = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    below = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(below <= 0, 0.0).otherwise(n * gap * gap / F.when(below > 0, below).otherwise(1.0))


def over_represented(df: DataFrame, percentile: float = 0.9, least: int = 10, least_viral: int = 5, critical: float = 3.841459, top: int = 8) -> DataFrame:
    """Clusters whose share of viral posts is above that of the rest: Yates chi-square from `critical` on, ranked by rate * ln(n).
    With fewer than 3 * `least` posts or `least` viral ones there are none."""
    c = clusters(df, percentile)
    whole = c.agg(F.sum("viral").alias("all_viral"), F.sum("n").alias("all_n"))
    c = c.crossJoin(F.broadcast(whole)).where((F.col("n") >= least) & (F.col("viral") >= least_viral))
    c = c.where((F.col("all_n") >= 3 * least) & (F.col("all_viral") >= least))
    x = chi_square(F.col("viral"), F.col("n") - F.col("viral"), F.col("all_viral") - F.col("viral"), F.col("all_n") - F.col("n") - F.col("all_viral") + F.col("viral"))
    c = c.withColumn("chi2", x).where((F.col("chi2") >= critical) & (F.col("viral") * F.col("all_n") > F.col("all_viral") * F.col("n")))
    keys = ["tier", "hook", "narrative", "content_type"]
    return c.orderBy(F.desc(F.col("rate") * F.log("n")), *keys).limit(top).select(*keys, "viral", "n", "rate", "chi2")


def anti_patterns(df: DataFrame, percentile: float = 0.9, least: int = 10, shown: int = 3) -> DataFrame:
    """Buckets of non-viral posts with the share below the global median and the first `shown` posts by doc_id. `df` has
    features(). Fewer than `least` non-viral posts give none."""
    m = df.agg(F.percentile("upvotes", F.lit(percentile)).alias("threshold"), F.median("upvotes").alias("median"))
    bucket = F.when(F.col("title_words") < 5, "very_short_title").when(F.col("title_words") > 30, "very_long_title").when(F.col("body_words") == 0, "no_body_text")
    bucket = bucket.when(F.col("body_words") > 1000, "very_long_body").otherwise("generic_low_engagement")
    low = df.crossJoin(F.broadcast(m)).where(F.col("upvotes") < F.col("threshold")).select(bucket.alias("bucket"), "post_id", "doc_id", "upvotes", "median")
    g = low.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("upvotes") < F.col("median")).alias("failed")).where(F.col("n") >= least)
    first = low.withColumn("_i", F.row_number().over(W.partitionBy("bucket").orderBy("doc_id"))).where(F.col("_i") <= shown)
    first = first.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "post_id"))), lambda x: x["post_id"]).alias("exemplars"))
    return g.join(first, "bucket").select("bucket", "n", (F.col("failed").cast("double") / F.col("n").cast("double")).alias("failure_rate"), "exemplars")


# Words that no title template holds.
STOP = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "to", "of", "in", "for",
    "on", "with", "at", "by", "from", "and", "but", "or", "not", "so", "if", "this", "that", "it", "i", "me", "my", "we", "our", "you", "your", "he",
    "she", "what", "which", "who", "when", "where", "why", "how", "just", "about", "like", "all", "can", "get", "one", "really",
)


def templates(viral: DataFrame, keys: list[str], share: float = 0.15, top: int = 10, most: int = 5) -> DataFrame:
    """Per cluster with at least 3 titles: of its `top` most frequent bigrams of title words (no stop words, over 2 letters)
    at most `most` that occur max(2, share of the titles) times, joined by a pipe. Ties go by the alphabet."""
    words = F.filter(F.transform(F.split(F.trim(F.regexp_replace("title", r"\s+", " ")), " "), lambda w: F.btrim(F.lower(w), F.lit(".,!?:;\"'()[]"))), lambda w: ~w.isin(*STOP) & (F.length(w) > 2))
    rest = F.greatest(F.size("_w") - 1, F.lit(0))
    grams = F.zip_with(F.slice("_w", F.lit(1), rest), F.slice("_w", F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b))
    titles = viral.where(F.col("title") != "")
    enough = titles.groupBy(*keys).agg(F.count("*").alias("_titles")).where("_titles >= 3")
    counts = titles.withColumn("_w", words).select(*keys, F.explode(grams).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("_k"))
    ranked = counts.join(F.broadcast(enough), keys).withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_k"), "gram")))
    ranked = ranked.where((F.col("_r") <= top) & (F.col("_k") >= F.greatest(F.lit(2).cast("long"), F.floor(F.col("_titles") * share))))
    return ranked.groupBy(*keys).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("_r", "gram"))), 1, most), lambda x: x["gram"]).alias("grams")).select(*keys, F.array_join("grams", "|").alias("template"))


def described(df: DataFrame, patterns: DataFrame, percentile: float, by: list[str] | None = None) -> DataFrame:
    """`patterns` (few, by cluster) with the template and the p25-p75 ranges of title and body words of their viral posts in
    `df`: those from the score percentile of all posts on, or of each group of `by`."""
    keys = ["tier", "hook", "narrative", "content_type"]
    line = F.broadcast(viral_threshold(df, percentile, by or []))
    viral = (df.join(line, by) if by else df.crossJoin(line)).where(F.col("upvotes") >= F.col("threshold")).join(F.broadcast(patterns.select(*keys)), keys)
    quarter = lambda c, p, text: F.floor(F.percentile(F.when(F.col(text) != "", F.col(c)), F.lit(p)))
    ranges = viral.groupBy(*keys).agg(quarter("title_words", 0.25, "title").alias("t_lo"), quarter("title_words", 0.75, "title").alias("t_hi"), quarter("body_words", 0.25, "body").alias("b_lo"), quarter("body_words", 0.75, "body").alias("b_hi"))
    return patterns.join(ranges, keys, "left").join(templates(viral, keys), keys, "left")


def detailed(df: DataFrame, patterns: DataFrame, percentile: float, shown: int = 5) -> DataFrame:
    """described() patterns with `exemplars`, their first `shown` viral posts by doc_id, and `communities`, where the cluster's
    posts are. The posts of a cluster are cut to `shown` before they are gathered."""
    keys = ["tier", "hook", "narrative", "content_type"]
    few = F.broadcast(patterns.select(*keys))
    own = df.join(few, keys)
    viral = own.crossJoin(F.broadcast(viral_threshold(df, percentile, []))).where(F.col("upvotes") >= F.col("threshold"))
    first = viral.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy("doc_id"))).where(F.col("_i") <= shown)
    first = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "post_id"))), lambda x: x["post_id"]).alias("exemplars"))
    places = own.groupBy(*keys).agg(F.array_sort(F.collect_set("subreddit")).alias("communities"))
    return described(df, patterns, percentile).join(first, keys, "left").join(places, keys, "left")


def title_match(title: Column, template: Column) -> Column:
    """0, or 0.4 + 0.6 * the share of the template's bigrams that the lower-cased title holds."""
    grams = F.filter(F.split(F.coalesce(template, F.lit("")), r"\|"), lambda g: g != "")
    found = F.size(F.filter(grams, lambda g: F.contains(F.lower(title), g)))
    return F.when(found > 0, 0.4 + 0.6 * found / F.greatest(F.size(grams), F.lit(1))).otherwise(0.0)


def match_score(p: Column) -> Column:
    """How well a post with features() fits pattern `p`: 0.20 hook, 0.20 narrative, 0.35 title_match, 0.125 for each range."""
    hit = lambda test, weight: F.when(test, weight).otherwise(0.0)
    words = hit(F.coalesce("title_words", F.lit(0)).between(p["t_lo"], p["t_hi"]), 0.125) + hit(F.coalesce("body_words", F.lit(0)).between(p["b_lo"], p["b_hi"]), 0.125)
    return hit(F.col("hook") == p["hook"], 0.2) + hit(F.col("narrative") == p["narrative"], 0.2) + title_match(F.col("title"), p["template"]) * 0.35 + words


def matched(df: DataFrame, patterns: DataFrame, least: float = 0.45) -> DataFrame:
    """Posts with `predicted`: some pattern's match_score is from `least` on, whatever its tier and media. The patterns, a
    top-k with described(), travel as one array."""
    fields = ["hook", "narrative", "template", "t_lo", "t_hi", "b_lo", "b_hi"]
    all_of = patterns.agg(F.collect_list(F.struct(*fields)).alias("_patterns"))
    return df.crossJoin(F.broadcast(all_of)).withColumn("predicted", F.exists("_patterns", lambda p: match_score(p) >= least)).drop("_patterns")


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str]) -> DataFrame:
    g = df.select(*by, predicted.alias("p"), actual.alias("a")).groupBy(*by).agg(F.count_if(F.expr("p AND a")).alias("tp"), F.count_if(F.expr("p AND NOT a")).alias("fp"), F.count_if(F.expr("NOT p AND a")).alias("fn"), F.count_if(F.expr("NOT p AND NOT a")).alias("tn"))
    share = lambda x, y: F.when(y > 0, x.cast("double") / y.cast("double")).otherwise(0.0)
    tp = F.col("tp")
    return g.select(*by, "tp", "fp", "fn", "tn", share(tp, tp + F.col("fp")).alias("precision"), share(tp, tp + F.col("fn")).alias("recall"), share(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"))


def backtest(df: DataFrame, split_at: str, percentile: float = 0.8, least: float = 0.45) -> DataFrame:
    """Significant patterns mined before `split_at`, matched with the posts from then on, by tier. Undated posts take no part."""
    f = features(df).where("created_utc IS NOT NULL")
    train, test = f.where(F.col("created_utc") < F.lit(split_at).cast("timestamp")), f.where(F.col("created_utc") >= F.lit(split_at).cast("timestamp"))
    patterns = described(train, over_represented(train, percentile), percentile)
    test = matched(test, patterns, least).crossJoin(F.broadcast(viral_threshold(test, percentile, [])))
    return confusion(test, F.col("predicted"), F.col("upvotes") >= F.col("threshold"), ["tier"])


def target_encoding(df: DataFrame, percentile: float = 0.75) -> DataFrame:
    """Per community: its score percentile and the share of posts from it on."""
    t = viral_threshold(df, percentile, ["subreddit"])
    g = df.join(t, "subreddit").groupBy("subreddit", "threshold").agg(F.count("*").alias("n"), F.count_if(F.col("upvotes") >= F.col("threshold")).alias("k"))
    return g.select("subreddit", "threshold", "n", (F.col("k").cast("double") / F.col("n").cast("double")).alias("viral_rate"))


def random_split(df: DataFrame, seed: int = 42) -> DataFrame:
    """60/40 within each community by the rank of a hash, at least one row in train."""
    w = W.partitionBy("subreddit")
    r = F.row_number().over(w.orderBy(F.md5(F.concat_ws("-", "post_id", F.lit(seed)).cast("binary")), "post_id"))
    return df.withColumn("split", F.when(r <= F.greatest(F.lit(1).cast("long"), F.floor(F.count("*").over(w) * 3 / 5)), "train").otherwise("test"))
