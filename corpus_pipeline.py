"""Five stages from raw documents to packed sequences; each reads the table that the stage before it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractionlens.llm.decontamination import decontaminate
from tractionlens.llm.near_dedup import near_duplicates
from tractionlens.llm.packing import pack
from tractionlens.llm.quality_rules import quality_rules
from tractionlens.llm.shared import WORD, written
from tractionlens.llm.substring_dedup import repeated_strings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(text) -> list:
    """The columns of documents with another text."""
    return ["doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars")]


def _key() -> Column:
    """doc_id, or for rows without one a stand-in from the text: above 2**62, so a document with an id is kept before it."""
    stand_in = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(F.col("doc_id").cast("long"), stand_in)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    judged = quality_rules(docs.select(*COLUMNS), carry=True).where("kept")
    return judged.select("input_row.*", "clean_text").select(*_with_text(F.col("clean_text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, or where none has an id the one with
    the smallest stand-in. Of several rows of that id one stays; texts without words link with nothing and all stay."""
    keyed = docs.select(*COLUMNS, _key().alias("_key"))
    kept = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), k=5, percent=80).where("kept").select(F.col("doc_id").alias("_key")).distinct()
    rows = keyed.join(kept, "_key", "left_semi")
    linked = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    one = rows.where(linked).groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return rows.where(~linked).select(*COLUMNS).union(one)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes and the passages of over 50 words that repeat; what remains of a cut character
    goes. Emptied documents go."""
    cut = repeated_strings(docs, words=51).where("n_removed > 0").select("sha", "kept_text").dropDuplicates(["sha"])
    keyed = docs.select(*COLUMNS, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    out = keyed.join(cut, "sha", "left")
    text = F.when(F.col("kept_text").isNull(), F.col("text")).otherwise(F.regexp_replace(F.make_valid_utf8(F.col("kept_text").cast("string")), "\ufffd", ""))
    return out.select(*_with_text(text)).where("text IS NULL OR text <> ''")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = docs.select(*COLUMNS, _key().alias("_key"))
    found = decontaminate(keyed.select(F.col("_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(found, "_key", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return pack(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Subword ids, and so the last stage, have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
