"""Choosing communities and patterns for requests, and predicting how titles will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractionlens.functions import text as T
from tractionlens.operators import analysis as A
from tractionlens.operators import feedback as B


def keyword_index(df: DataFrame, least: int = 3, top: int = 80, used: int = 30) -> DataFrame:
    """The keywords of each community's titles that requests are matched with: (subreddit, word, n, rank)."""
    return A.keywords(df, "title", T.STOP_WORDS, least, top, ["subreddit"]).where(F.col("rank") <= used)


def communities_for(requests: DataFrame, index: DataFrame, hints: DataFrame, top: int = 3) -> DataFrame:
    """The `top` communities of each request (request_id, text): 2 for a hint word, 1 for a keyword, over 5 and at most 1.

    `hints` (word, subreddit) and `index` are small next to the requests; the planner decides whether they are sent to the
    tasks. A community named by the request itself scores 1. Requests without a hit get no row."""
    words = requests.select("request_id", F.explode(T.tokens(F.col("text"))).alias("word"))
    weights = hints.select("word", "subreddit", F.lit(2).alias("weight")).union(index.select("word", "subreddit", F.lit(1)))
    hits = words.join(weights, "word").groupBy("request_id", "subreddit").agg(F.sum("weight").alias("raw"))
    named = words.join(index.select("subreddit").distinct(), F.col("word") == F.lower("subreddit")).select("request_id", "subreddit", F.lit(5).cast("long").alias("raw"))
    scored = hits.union(named).groupBy("request_id", "subreddit").agg(F.least(F.max("raw") / 5, F.lit(1.0)).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("score"), "subreddit"))).where(F.col("rank") <= top)


def pattern_score(applies: Column, works_in_tier: Column, rate: Column, live: Column, sample: Column, hook: Column, words: Column) -> Column:
    """0 to 100: 40 for the community (10 for a tier), up to 30 for the rate (0.7 of it and 0.3 of the live one, where there is
    one), 15, 8 or 3 for the sample, 15 for a request word in the hook's name and 8 for one of its topics."""
    blended = F.when(live.isNotNull(), 0.7 * rate + 0.3 * live).otherwise(rate)
    joined = F.lower(F.array_join(words, " "))
    topic = F.lit(False)
    for name, topics in T.HOOK_TOPICS.items():
        topic = topic | ((hook == name) & T.has_any(joined, topics))
    inside = F.exists(words, lambda w: F.contains(hook, F.lower(w)))
    fit = F.when(F.size(words) == 0, 0).when(inside, 15).when(topic, 8).otherwise(0)
    return F.when(applies, 40).when(works_in_tier, 10).otherwise(0) + F.least(blended * 40, F.lit(30.0)) + F.when(sample >= 100, 15).when(sample >= 30, 8).otherwise(3) + fit


def best_patterns(patterns: Column, tier: Column, words: Column, top: int = 3) -> Column:
    """Of an array of patterns the `top` with the best score for a request of `tier` and `words`, best first, one of each hook:
    structs (pattern_id, hook, score). All within the request's row: no join, no shuffle."""
    score = lambda p: F.round(pattern_score(p["tier"] == tier, F.lit(True), p["rate"], p["live"], p["n"], p["hook"], words), 9)
    scored = F.array_sort(F.transform(patterns, lambda p: F.struct((-score(p)).alias("_s"), p["pattern_id"].alias("pattern_id"), p["hook"].alias("hook"))))
    # a one-element array binds the sorted patterns, which are looked at once for each of them
    first = lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda y: y["hook"] == x["hook"]))
    kept = F.transform(F.array(scored), first)[0]
    return F.slice(F.transform(kept, lambda x: F.struct(x["pattern_id"].alias("pattern_id"), x["hook"].alias("hook"), (-x["_s"]).alias("score"))), 1, top)


def with_patterns(requests: DataFrame, patterns: DataFrame, top: int = 3) -> DataFrame:
    """requests (tier, words, ...) with `patterns`, see best_patterns(). `patterns` is a top-k of mining, so it travels as one array."""
    all_of = patterns.agg(F.collect_list(F.struct("pattern_id", "tier", "hook", "rate", "live", "n")).alias("_p"))
    return requests.crossJoin(F.broadcast(all_of)).withColumn("patterns", best_patterns(F.col("_p"), F.col("tier"), F.col("words"), top)).drop("_p")


def select_patterns(requests: DataFrame, patterns: DataFrame, top: int = 3) -> DataFrame:
    """For each request (request_id, tier, words) the `top` patterns with the best score, one of each hook."""
    found = with_patterns(requests, patterns, top).select("request_id", F.posexplode("patterns").alias("_i", "p"))
    return found.select("request_id", "p.pattern_id", "p.hook", "p.score", (F.col("_i") + 1).alias("rank"))


def recommended(requests: DataFrame, index: DataFrame, hints: DataFrame, patterns: DataFrame, tiers: DataFrame, default: str, top: int = 3, matched: int = 5) -> DataFrame:
    """Per request (request_id, text): the `matched` communities it fits (`default` where none does), and for the first of them its
    tier by tiers (subreddit, tier), the `top` patterns, a flair for the text, and the best window to post in.

    Only the words of requests are shuffled, to meet the keywords; the rest is worked out within a request's row."""
    hits = communities_for(requests, index, hints, matched)
    listed = hits.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "subreddit"))), lambda x: x["subreddit"]).alias("_m"))
    all_ = requests.join(listed, "request_id", "left").withColumn("communities", F.coalesce("_m", F.array(F.lit(default)))).drop("_m")
    all_ = all_.withColumns({"subreddit": F.col("communities")[0], "words": T.request_words(F.col("text"))})
    all_ = all_.join(tiers.groupBy("subreddit").agg(F.min("tier").alias("tier")), "subreddit", "left")
    window = lambda ws: F.struct(F.lit(ws[0][0]).alias("day"), F.lit(ws[0][1]).alias("window"))
    when = window(B.WINDOWS)
    for community, windows in B.COMMUNITY_WINDOWS.items():
        when = F.when(F.col("subreddit") == community, window(windows)).otherwise(when)
    out = with_patterns(all_, patterns, top).withColumns({"flair": T.flair(F.col("text")), "_w": when})
    return out.select("request_id", "communities", "subreddit", "tier", "patterns", "flair", "_w.day", "_w.window")


def generic_patterns(patterns: DataFrame, top: int) -> DataFrame:
    return patterns.orderBy(F.desc("rate"), F.desc("n"), "pattern_id").limit(top)


def predictions(candidates: DataFrame, history: DataFrame, least: int = 3) -> DataFrame:
    """Each candidate (user_id, subreddit, pattern_id) from the user's history there: score, low, high, confidence.

    Fewer than `least` rows with a score above 0: score 50 and no range. A pattern without history: 40. Else 60 times its
    average over the community's and 30 times its share above that average, whole, within 5 to 95."""
    rows = history.where("actual_upvotes > 0").groupBy("user_id", "subreddit", F.coalesce("pattern_id", F.lit("unknown")).alias("pattern_id"), "actual_upvotes").agg(F.count("*").alias("k"))
    u = F.col("actual_upvotes")
    whole = rows.groupBy("user_id", "subreddit").agg(F.sum("k").alias("all_n"), F.sum(u * F.col("k")).alias("all_sum"), F.max(u).alias("top"))
    whole = whole.withColumn("avg", F.col("all_sum").cast("double") / F.col("all_n"))
    own = rows.join(whole.select("user_id", "subreddit", "avg"), ["user_id", "subreddit"]).groupBy("user_id", "subreddit", "pattern_id")
    own = own.agg(F.sum("k").alias("n"), F.sum(u * F.col("k")).alias("s"), F.sum(F.when(u > F.col("avg"), F.col("k")).otherwise(0)).alias("above"))
    c = candidates.join(whole, ["user_id", "subreddit"], "left").join(own, ["user_id", "subreddit", "pattern_id"], "left")
    n = F.coalesce("n", F.lit(0))
    raw = F.floor(F.col("s").cast("double") / F.col("n") / F.greatest("avg", F.lit(1.0)) * 60 + F.col("above").cast("double") / F.col("n") * 30)
    score = F.when(F.coalesce("all_n", F.lit(0)) < least, 50).when(n == 0, 40).otherwise(F.least(F.lit(95), F.greatest(F.lit(5), raw))).cast("long")
    c = c.withColumns({"n": n.cast("long"), "score": score, "known": F.coalesce(F.col("all_n") >= least, F.lit(False))})
    s = F.col("score")
    low = F.when(s >= 80, F.col("top") * 0.6).when(s >= 60, F.col("avg") * 0.8).when(s >= 40, F.col("avg") * 0.4).otherwise(0.0)
    high = F.when(s >= 80, F.col("top") * 1.2).when(s >= 60, F.col("avg") * 1.5).when(s >= 40, F.col("avg")).otherwise(F.col("avg") * 0.4)
    confidence = F.when(~F.col("known"), "low").when(F.col("n") >= 10, "high").when(F.col("n") >= 5, "medium").otherwise("low")
    return c.select("user_id", "subreddit", "pattern_id", "n", "score", *[F.when(F.col("known"), F.floor(x)).alias(k) for k, x in (("low", low), ("high", high))], confidence.alias("confidence"))


def history(generations: DataFrame, feedback: DataFrame) -> DataFrame:
    """Generations with their last feedback's class, '-' where there is none."""
    last = feedback.groupBy("doc_id").agg(F.max(F.struct("tracked_at", "event_id", "performance")).alias("_l"))
    return generations.join(last, "doc_id", "left").withColumn("performance", F.coalesce("_l.performance", F.lit("-"))).drop("_l")
