"""Evolution of patterns: success rates, failure streaks and a log, whole or batch by batch from a carried state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractionlens.functions import drafts as D
from tractionlens.operators import feedback as B

STATE = "pattern_id string, n long, ok long, streak long, oldest struct<at: timestamp, id: long>, newest struct<at: timestamp, id: long>"
RATED = "pattern_id string, n long, success_rate double, streak long, status string"
LOG = "pattern_id string, kind string, old_rate double, new_rate double, streak long"


def folded(feedback: DataFrame) -> DataFrame:
    """The state of each pattern over feedback with performance: rows, successes, newest consecutive failures, first and last
    row by (tracked_at, event_id)."""
    at = F.struct(F.col("tracked_at").alias("at"), F.col("event_id").cast("long").alias("id"))
    ok = F.col("performance") != "failed"
    g = feedback.groupBy("pattern_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.min(at).alias("oldest"), F.max(at).alias("newest"))
    return g.join(B.streaks(feedback).select("pattern_id", "streak"), "pattern_id").select("pattern_id", "n", "ok", "streak", "oldest", "newest")


def advanced(state: DataFrame, part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state after the rows of `part`, patterns that must be folded anew). Counts add up. The streak goes on where the part
    holds no success, else the part's own holds; that needs every row of the part after all before, so patterns with a row
    that came late are left out and returned by id."""
    p = part.select("pattern_id", *[F.col(c).alias(f"p_{c}") for c in part.columns if c != "pattern_id"])
    both = state.join(p, "pattern_id", "full")
    late = F.coalesce(F.col("p_oldest") <= F.col("newest"), F.lit(False))
    add = lambda c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"p_{c}"), F.lit(0))
    streak = F.when(F.col("p_n").isNull(), F.col("streak")).when(F.col("p_ok") > 0, F.col("p_streak")).otherwise(add("streak"))
    out = both.where(~late).select("pattern_id", add("n").alias("n"), add("ok").alias("ok"), streak.alias("streak"), F.coalesce("oldest", "p_oldest").alias("oldest"), F.coalesce("p_newest", "newest").alias("newest"))
    return out, both.where(late).select("pattern_id")


def rated(patterns: DataFrame, state: DataFrame, inactive_from: int = 10) -> DataFrame:
    """patterns (pattern_id, success_rate, status) with the state's rates: pattern_id, n, success_rate, streak, status and the
    old rate and status. Patterns without feedback keep their rate (n is 0). A pattern that fails `inactive_from` times in a row
    goes inactive and stays so."""
    old = patterns.select("pattern_id", F.col("success_rate").alias("old_rate"), F.col("status").alias("old_status"))
    rate = F.round(F.col("ok").cast("double") / F.col("n"), 4)
    fails = F.coalesce(F.col("streak") >= inactive_from, F.lit(False))
    status = F.when(fails | (F.col("old_status") == "inactive"), "inactive").otherwise(F.coalesce("old_status", F.lit("active")))
    return old.join(state, "pattern_id", "left").select("pattern_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(rate, "old_rate").alias("success_rate"), F.coalesce("streak", F.lit(0)).alias("streak"), status.alias("status"), "old_rate", "old_status")


def changes(table: DataFrame, delta: float = 0.05) -> DataFrame:
    """The log of rated(): `up` or `down` where the rate moved by more than `delta`, `inactive` where a pattern went inactive."""
    moved = F.col("success_rate") - F.coalesce("old_rate", F.lit(0.0))
    kinds = F.array_compact(F.array(F.when(moved > delta, "up").when(moved < -delta, "down"), F.when((F.col("status") == "inactive") & (F.coalesce("old_status", F.lit("active")) != "inactive"), "inactive")))
    return table.where("n > 0").select("pattern_id", F.explode(kinds).alias("kind"), F.coalesce("old_rate", F.lit(0.0)).alias("old_rate"), F.col("success_rate").alias("new_rate"), "streak")


def evolved(patterns: DataFrame, feedback: DataFrame, gate: int = 50) -> tuple[DataFrame, DataFrame]:
    """(rated patterns, log) from all feedback with performance. With fewer than `gate` rows of feedback there is neither."""
    state = folded(feedback)
    enough = feedback.agg(F.count("*").alias("_all")).where(F.col("_all") >= gate)
    table = rated(patterns, state).join(F.broadcast(enough)).drop("_all")
    return table.drop("old_rate", "old_status"), changes(table)


def attributed(feedback: DataFrame, patterns: DataFrame, given: Column | None = None) -> DataFrame:
    """Failed feedback without an attribution (`given`: null), with `attribution`: why it failed by its title, body, upvote
    ratio and its pattern's success rate. An unknown pattern has no rate."""
    open_ = F.col("performance") == "failed"
    open_ = open_ if given is None else open_ & given.isNull()
    rates = patterns.select("pattern_id", (F.col("success_rate") * 100).alias("_rate"))
    todo = feedback.where(open_).join(rates, "pattern_id", "left")
    return todo.withColumn("attribution", D.attribution(F.col("title"), F.col("body"), F.col("upvote_ratio"), F.col("_rate"))).drop("_rate")
