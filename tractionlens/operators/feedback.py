"""Tracking of posts and evolution of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractionlens.functions import text as T


def community_medians(df: DataFrame, score: str) -> DataFrame:
    return df.where(F.col(score) > 0).groupBy("subreddit").agg(F.median(score).alias("median"))


def classified(feedback: DataFrame, medians: DataFrame, default: float = 50.0) -> DataFrame:
    """Feedback with the community's median (else `default`) and the performance class."""
    df = feedback.join(medians, "subreddit", "left").withColumn("median", F.coalesce("median", F.lit(default)))
    return df.withColumn("performance", T.performance(F.col("actual_upvotes"), F.col("median")))


def success_rates(df: DataFrame, gate: int = 50) -> DataFrame:
    ok = F.count_if(F.col("performance") != "failed").cast("double")
    g = df.groupBy("pattern_id").agg(F.count("*").alias("n"), (ok / F.count("*").cast("double")).alias("success_rate"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("all")))).where(F.col("all") >= gate).drop("all")


def streaks(df: DataFrame, inactive_from: int = 10) -> DataFrame:
    """Newest consecutive failures of each pattern. The newest success is one aggregate; failures after it are another, so no window sorts a hot pattern."""
    at = F.struct("tracked_at", "event_id")
    last = df.where(F.col("performance") != "failed").groupBy("pattern_id").agg(F.max(at).alias("ok"))
    g = df.join(last, "pattern_id", "left").groupBy("pattern_id").agg(F.count_if(F.col("ok").isNull() | (at > F.col("ok"))).alias("streak"))
    return g.select("pattern_id", "streak", F.when(F.col("streak") >= inactive_from, "inactive").otherwise("active").alias("status"))


def history_of(df: DataFrame, user=None, community: str | None = None, generation=None, newest: int = 50) -> DataFrame:
    """The newest rows of feedback of a user, of a community (without case), of a generation, or of what is given of these."""
    tests = {"user_id": user, "generation_id": generation}
    for column, value in tests.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    if community is not None:
        df = df.where(F.lower("subreddit") == community.lower())
    return df.orderBy(F.desc("tracked_at"), F.desc("event_id")).limit(newest)


def dashboard(df: DataFrame, newest: int = 5) -> DataFrame:
    """Per user, over feedback with a score above 0: totals, survival, the community with the best average, milestones reached,
    and the newest rows as community:score:class."""
    df = df.where("actual_upvotes > 0")
    per = df.groupBy("user_id", "subreddit").agg(F.count("*").alias("n"), F.sum("actual_upvotes").alias("s"), F.max("actual_upvotes").alias("m"), F.count_if(F.col("performance") != "failed").alias("k"))
    best = F.max(F.struct((F.col("s").cast("double") / F.col("n").cast("double")).alias("avg"), "subreddit"))
    g = per.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("s").alias("total"), F.max("m").alias("top"), F.sum("k").alias("k"), best.alias("b"))
    hit = F.size(T.milestones(F.lit(0), F.col("top"))).cast("long")
    last = df.withColumn("_i", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("tracked_at"), F.desc("event_id")))).where(F.col("_i") <= newest)
    said = F.concat_ws(":", "subreddit", F.col("actual_upvotes").cast("string"), "performance")
    recent = last.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", said.alias("said")))), lambda x: x["said"]), " ").alias("recent"))
    return g.join(recent, "user_id").select("user_id", "n", "total", (F.col("total").cast("double") / F.col("n").cast("double")).alias("avg_upvotes"), (F.col("k").cast("double") / F.col("n").cast("double")).alias("survival"), F.col("b.subreddit").alias("best_subreddit"), hit.alias("milestones"), "recent")


# Windows with their scores that hold where a user has little history, for some communities and for all others.
COMMUNITY_WINDOWS = {
    "SaaS": (("Tuesday", "14:00-17:00 UTC", 85), ("Wednesday", "13:00-16:00 UTC", 80), ("Thursday", "15:00-18:00 UTC", 75)),
    "ExperiencedDevs": (("Tuesday", "15:00-18:00 UTC", 90), ("Wednesday", "14:00-17:00 UTC", 82), ("Monday", "16:00-19:00 UTC", 70)),
    "webdev": (("Monday", "14:00-17:00 UTC", 80), ("Thursday", "13:00-16:00 UTC", 78), ("Saturday", "10:00-14:00 UTC", 65)),
    "SideProject": (("Saturday", "12:00-16:00 UTC", 88), ("Sunday", "14:00-18:00 UTC", 82), ("Wednesday", "16:00-20:00 UTC", 65)),
}
WINDOWS = (("Tuesday", "14:00-17:00 UTC", 70), ("Wednesday", "13:00-16:00 UTC", 68), ("Thursday", "15:00-18:00 UTC", 65))


def best_times(df: DataFrame, communities: dict[str, tuple[tuple[str, str, int], ...]] | None = None, default: tuple[tuple[str, str, int], ...] = WINDOWS, least: int = 5) -> DataFrame:
    """Per user and community: its windows with scores, best first. With `least` rows above 0 a window gains the user's average
    there on its weekday by five, whole, at most 20, up to 99; ties keep the windows' order."""
    communities = COMMUNITY_WINDOWS if communities is None else communities
    listed = lambda windows: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("day"), F.lit(w).alias("window"), F.lit(s).cast("long").alias("base")) for i, (d, w, s) in enumerate(windows)])
    name, own = F.substring_index(F.replace("subreddit", F.lit("r/"), F.lit("")), "/", 1), listed(default)
    for community, windows in communities.items():
        own = F.when(name == community, listed(windows)).otherwise(own)
    up = F.col("actual_upvotes") > 0
    groups = df.groupBy("user_id", "subreddit").agg(F.count_if(up).alias("n"))
    per = df.where(up).groupBy("user_id", "subreddit", F.date_format("tracked_at", "EEEE").alias("day")).agg(F.avg("actual_upvotes").alias("a"))
    out = groups.select("user_id", "subreddit", "n", F.inline(own)).join(per, ["user_id", "subreddit", "day"], "left")
    boost = F.least(F.lit(20).cast("long"), F.floor(F.col("a") / 5))
    score = F.when((F.col("n") >= least) & F.col("a").isNotNull(), F.least(F.lit(99).cast("long"), F.col("base") + boost)).otherwise(F.col("base"))
    out = out.withColumn("score", score)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("user_id", "subreddit").orderBy(F.desc("score"), "i"))).select("user_id", "subreddit", "day", "window", "score", "rank")
