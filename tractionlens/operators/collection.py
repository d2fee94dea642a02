"""Collection of posts from several sources: merge, two deduplications, tiers, a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tractionlens.operators import analysis as A
from tractionlens.sources.storage import written


def merged(existing: DataFrame, new: DataFrame, key: str = "post_id") -> DataFrame:
    """`existing` and those rows of `new` whose key it doesn't have. Rows of `new` without a key, and rows of one key within
    it, all come along; columns that one side lacks are null."""
    added = new.join(existing.select(key).distinct(), key, "left_anti")
    return existing.unionByName(added, allowMissingColumns=True)


def _first(order: list[Column], columns: list[str]) -> Column:
    """The row that is largest by `order`, as a struct of `columns`. An aggregate: no window, no sort of a hot key."""
    return F.max_by(F.struct(*columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("row")


def distinct_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the largest by `order`. Rows without a key (null or empty) are all kept."""
    named = F.coalesce(F.col(key) != "", F.lit(False))
    best = df.where(named).groupBy(F.col(key).alias("_key")).agg(_first(order, df.columns)).select("row.*")
    return best.unionByName(df.where(~named))


def by_id(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per post_id: the highest score, of equal scores the first by `seq`. Rows that differ in their score only, such as
    snapshots of one post, are reduced to the highest in a hash aggregate first; what is sorted is one row for each post and source."""
    others = [c for c in df.columns if c != "upvotes"]
    if "map<" not in df.schema.simpleString():  # maps are no grouping keys
        named = F.coalesce(F.col("post_id") != "", F.lit(False))
        df = df.where(named).groupBy(*others).agg(F.max("upvotes").alias("upvotes")).select(*df.columns).unionByName(df.where(~named))
    return distinct_by(df, "post_id", [F.col("upvotes"), -F.col(seq)])


def crossposts(df: DataFrame, seq: str = "seq") -> DataFrame:
    """(post_id, source_subreddit, target_post_id): posts whose url another post with a higher score has (of equal scores one
    that comes first by `seq`), and that post. `df` has one row per post_id."""
    linked = df.where(F.coalesce(F.col("url") != "", F.lit(False)))
    best = linked.groupBy("url").agg(F.max_by("post_id", F.struct(F.col("upvotes"), -F.col(seq))).alias("target_post_id"), F.count("*").alias("_n")).where("_n > 1")
    lost = linked.join(best, "url").where("post_id <> target_post_id")
    return lost.select("post_id", F.col("subreddit").alias("source_subreddit"), "target_post_id")


def by_url(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per url, chosen as in by_id(); posts without a url are all kept."""
    return distinct_by(df, "url", [F.col("upvotes"), -F.col(seq)])


def with_tiers(df: DataFrame, tiers: DataFrame) -> DataFrame:
    """`df` with the tier of its community by tiers (subreddit, tier), names without case; null for others."""
    known = tiers.groupBy(F.lower("subreddit").alias("_s")).agg(F.min("tier").alias("tier"))
    return df.drop("tier").join(known, F.lower(df["subreddit"]) == F.col("_s"), "left").drop("_s")


def collected(sources: list[DataFrame], tiers: DataFrame, target: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posts, crossposts, report) of sources in order of trust, each with post_id, subreddit, upvotes, url and source_dataset.

    A later source adds only posts whose id no earlier one has. Ties go to the earlier source, then to the smaller `seq` where a
    source has one (up to 2**57), else to the row read first. Then one row per id and one per url stay, with the tier of the
    community. report: (dimension, value, n): posts per subreddit, source and tier (unknown without one), the steps' counts, and
    the shortfall of every community of `tiers` below `target`. The steps are counted while the posts are written once; the
    rest is read from the written table's three columns."""
    steps = Observation("steps")
    arrival = lambda s: F.col("seq") if "seq" in s.columns else F.monotonically_increasing_id()
    rows = [s.withColumn("seq", F.lit(i << 57) + arrival(s)) for i, s in enumerate(sources)]
    all_ = rows[0]
    for r in rows[1:]:
        all_ = merged(all_, r)
    single = written(by_id(all_.observe(steps, F.count(F.lit(1)).alias("merged"))), "single")
    links = written(crossposts(single), "crossposts")
    posts = written(with_tiers(by_url(single), tiers).drop("seq"), "posts")

    spark = posts.sparkSession
    seen = [("merged", steps.get["merged"]), ("single", single.count()), ("crossposts", links.count())]
    counted = A.counts(posts, ["subreddit", "source_dataset", "tier"])
    step_rows = spark.createDataFrame(seen, "value string, n long").select(F.lit("step").alias("dimension"), "value", "n")
    gaps = A.gaps(posts.select(F.lower("subreddit").alias("subreddit")), tiers.select(F.lower("subreddit").alias("subreddit")), target)
    return posts, links, counted.unionByName(step_rows).unionByName(gaps.select(F.lit("shortfall").alias("dimension"), F.col("subreddit").alias("value"), F.col("shortfall").alias("n")))


def score_profile(df: DataFrame, by: Column, name: str) -> DataFrame:
    """Per value of `by`: posts, communities, extremes and mean of the score, first and last day."""
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    u = F.col("upvotes")
    return df.groupBy(by.alias(name)).agg(F.count("*").alias("n"), F.count_distinct("subreddit").alias("communities"), F.min(u).alias("min_upvotes"), F.max(u).alias("max_upvotes"), F.avg(u).alias("avg_upvotes"), day(F.min("created_utc")).alias("first_day"), day(F.max("created_utc")).alias("last_day"))
