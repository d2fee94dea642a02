"""Posts, feedback and comments from the driver's tables, and the same adapter as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_by_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the post they belong to: consecutive events share a post."""
    events = table(spark, sf_dir, "events")
    sizes = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs")).crossJoin(events.agg(F.count("*").alias("n_events")))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return events.crossJoin(F.broadcast(sizes)).select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), F.floor(F.col("event_id") * F.col("n_docs") / F.col("n_events")).alias("doc_id"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = events_by_post(spark, sf_dir).groupBy("doc_id").agg(
        F.min("ts").alias("created_utc"),
        F.sum(F.floor(F.col("value") * 100 + 0.5)).alias("cents"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count("*").alias("n"),
        F.min("k").alias("k"),
    )
    docs = table(spark, sf_dir, "documents")
    title = F.substring(F.regexp_extract("text", r"^[^.\n]+", 0), 1, 200)
    number = F.substring("source", 4, 10).cast("int")
    df = docs.join(per, "doc_id", "left").withColumn("title", title)
    factor = F.when(F.col("lang") == "fr", 2).otherwise(1) * F.when(F.instr("text", "$") > 0, 3).otherwise(1)
    return df.select(
        F.concat(F.lit("t3_"), F.col("doc_id").cast("string")).alias("post_id"),
        "doc_id",
        F.col("source").alias("subreddit"),
        "title",
        F.trim(F.expr("substring(text, length(title) + 1)")).alias("body"),
        F.when(number < 4, "t1").when(number < 14, "t2").otherwise("t3").alias("tier"),
        F.when(F.col("lang") == "en", "text").when(F.col("lang") == "fr", "image").when(F.col("lang") == "es", "video").otherwise("link").alias("content_type"),
        F.col("created_utc").cast("timestamp").alias("created_utc"),
        F.floor(F.coalesce("cents", F.lit(0)) * factor / 100).alias("upvotes"),
        F.coalesce("clicks", F.lit(0)).alias("num_comments"),
        F.coalesce(1 - F.col("errors") / F.col("n"), F.lit(1.0)).alias("upvote_ratio"),
        F.when(F.col("k") < 5, F.concat(F.lit("f"), F.col("k").cast("string"))).alias("flair"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events_by_post(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("subreddit"))
    return ev.join(docs, "doc_id").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("tracked_at"), F.concat(F.lit("pattern_"), (F.col("k") % 8).cast("string")).alias("pattern_id"), F.floor("value").alias("actual_upvotes"), "subreddit")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("post_id"), F.col("turn").alias("depth"), F.length("text").cast("long").alias("upvotes"), F.concat_ws("_", "conv_id", "turn").alias("comment_id"))


POSTS_SQL = r"""ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  CAST(floor(event_id * (SELECT count(*) FROM documents) / (SELECT count(*) FROM events)) AS BIGINT) AS doc_id FROM events),
per AS (SELECT doc_id, min(ts) AS created_utc, sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS cents, count(*) FILTER (event_type = 'click') AS clicks,
  count(*) FILTER (event_type = 'error') AS errors, count(*) AS n, min(k) AS k FROM ev GROUP BY doc_id),
raw AS (SELECT d.*, p.created_utc, p.cents, p.clicks, p.errors, p.n, p.k, substring(regexp_extract(text, '^[^.\n]+'), 1, 200) AS title, CAST(substring(source, 4) AS INT) AS num
  FROM documents d LEFT JOIN per p USING (doc_id)),
posts AS (SELECT 't3_' || doc_id AS post_id, doc_id, source AS subreddit, title, trim(substring(text, length(title) + 1)) AS body,
  CASE WHEN num < 4 THEN 't1' WHEN num < 14 THEN 't2' ELSE 't3' END AS tier,
  CASE lang WHEN 'en' THEN 'text' WHEN 'fr' THEN 'image' WHEN 'es' THEN 'video' ELSE 'link' END AS content_type, created_utc,
  CAST(floor(coalesce(cents, 0) * (CASE WHEN lang = 'fr' THEN 2 ELSE 1 END) * (CASE WHEN contains(text, '$') THEN 3 ELSE 1 END) / 100) AS BIGINT) AS upvotes,
  coalesce(clicks, 0) AS num_comments, coalesce(1 - errors / n, 1.0)::DOUBLE AS upvote_ratio, CASE WHEN k < 5 THEN 'f' || k END AS flair FROM raw)"""
FEEDBACK_SQL = POSTS_SQL + r""",
feedback AS (SELECT e.event_id, e.user_id, e.ts AS tracked_at, 'pattern_' || (k % 8) AS pattern_id, CAST(floor(value) AS BIGINT) AS actual_upvotes, d.source AS subreddit
  FROM ev e JOIN documents d USING (doc_id))"""
