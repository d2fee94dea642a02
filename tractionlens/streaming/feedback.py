"""Feedback as a stream: classes, milestones, daily counts and re-evaluation of patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tractionlens.operators import evolution as E
from tractionlens.operators import feedback as B
from tractionlens.functions import text as T

SCHEMA = "event_id long, post_id string, pattern_id string, subreddit string, tracked_at timestamp, actual_upvotes long"


def feedback_stream(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """JSON-lines files as they land; an event that comes again within `late` counts once."""
    return spark.readStream.schema(SCHEMA).json(path).withWatermark("tracked_at", late).dropDuplicatesWithinWatermark(["event_id"])


def classified(stream: DataFrame, medians: DataFrame) -> DataFrame:
    """The stream joined to the table of community medians, with the performance class."""
    return B.classified(stream, medians)


def daily_counts(stream: DataFrame) -> DataFrame:
    """Events by day, pattern and class; rows later than the watermark allows are dropped."""
    g = stream.groupBy(F.window("tracked_at", "1 day"), "pattern_id", "performance").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("day"), "pattern_id", "performance", "n")


def milestones(stream: DataFrame) -> DataFrame:
    """Milestones that a post crosses, each once, over all micro-batches; the state of a post is its highest score."""

    def highest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        now = max([before, *(int(f["actual_upvotes"].max()) for f in frames if f["actual_upvotes"].notna().any())])
        state.update((now,))
        yield pd.DataFrame({"post_id": [key[0]], "before": [before], "now": [now]})

    keyed = stream.select("post_id", "actual_upvotes").groupBy("post_id")
    scores = keyed.applyInPandasWithState(highest, "post_id string, before long, now long", "top long", "append", GroupStateTimeout.NoTimeout)
    return scores.select("post_id", F.explode(T.milestones(F.col("before"), F.col("now"))).alias("milestone"))


def evolve(out: str, gate: int = 50, inactive_from: int = 10, delta: float = 0.05) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that carries the patterns' state from batch to batch under `out`:

    - feedback/batch=k: the rows of batch k, read again only for patterns that have a row older than one before;
    - state/batch=k: counts, streaks and the last row of every pattern after batch k;
    - rates/batch=k and log/batch=k: rated patterns and what changed, from the batch on that makes `gate` rows in all.

    Batch k starts from the newest state before k and replaces what an earlier run of k left, so a replay changes nothing."""

    def newest(spark: SparkSession, name: str, schema: str, before: int) -> DataFrame:
        spark.createDataFrame([], f"{schema}, batch long").write.mode("ignore").partitionBy("batch").parquet(f"{out}/{name}")
        table = spark.read.schema(f"{schema}, batch long").parquet(f"{out}/{name}").where(F.col("batch") < before)
        last = table.agg(F.max("batch")).first()[0]
        return table.where(F.col("batch") == F.lit(-1 if last is None else last)).drop("batch")

    def keep(df: DataFrame, name: str, batch_id: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{out}/{name}/batch={batch_id}")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = keep(batch, "feedback", batch_id)
        state, late = E.advanced(newest(spark, "state", E.STATE, batch_id), E.folded(rows))
        if late.limit(1).count():
            # a folder of a later batch may lie there when an older one is replayed
            past = spark.read.schema(StructType([*rows.schema.fields, StructField("batch", LongType())])).parquet(f"{out}/feedback").where(F.col("batch") <= batch_id)
            state = state.unionByName(E.folded(past.join(late, "pattern_id", "left_semi")))
        state = keep(state, "state", batch_id)
        if (state.agg(F.sum("n")).first()[0] or 0) < gate:
            return
        known = newest(spark, "rates", E.RATED, batch_id).select("pattern_id", "success_rate", "status")
        new = state.select("pattern_id").join(known, "pattern_id", "left_anti").select("pattern_id", F.lit(0.0).alias("success_rate"), F.lit("active").alias("status"))
        table = keep(E.rated(known.unionByName(new), state, inactive_from), "rated", batch_id)
        keep(table.drop("old_rate", "old_status"), "rates", batch_id)
        keep(E.changes(table, delta), "log", batch_id)

    return run
