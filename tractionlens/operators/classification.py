"""Classification by a model that the caller supplies, with a cache by content and a rule for what the model leaves open."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractionlens.sources.storage import opened

CACHE = "key string, label string, origin string"
ASKED = "keys array<string>, texts array<string>, response string"


def cache_key(text: Column, categories: dict[str, str], task: str, model: str) -> Column:
    """What an answer depends on: the model, the task, the categories and the text."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(task), F.lit("\x1e".join(f"{k}={v}" for k, v in categories.items())), text), 256)


def prompt(texts: list[str], categories: dict[str, str], task: str) -> str:
    """One question about all texts of a batch, numbered from 1."""
    known = "\n".join(f"- {name}: {about}" for name, about in categories.items())
    items = "\n".join(f'{i}. "{" ".join(text.split())}"' for i, text in enumerate(texts, 1))
    return f"Put each {task} below into one of these categories:\n{known}\n\nAnswer with {len(texts)} lines, each `number: category`, and nothing else.\n\n{items}"


def numbered_answers(response: Column, number: Column, names: list[str]) -> Column:
    """The category of the first line `number: category`, null without one. A category is told by its name, without case,
    or by a part of it that no other name has."""
    lines = F.filter(F.split(F.coalesce(response, F.lit("")), "\n"), lambda x: F.regexp_extract(x, r"^\s*([0-9]+)\s*[:.)]", 1) == number.cast("string"))
    said = F.btrim(F.lower(F.regexp_extract(F.get(lines, 0), r"^\s*[0-9]+\s*[:.)]\s*(\S+)", 1)), F.lit(".,;:!?\"'`*"))
    known = F.array(*[F.lit(k) for k in names])
    exact = F.filter(known, lambda k: F.lower(k) == said)
    near = F.filter(known, lambda k: F.contains(F.lower(k), said) | F.contains(said, F.lower(k)))
    return F.when(said != "", F.coalesce(F.get(exact, 0), F.when(F.size(near) == 1, F.get(near, 0))))


def _ask(ask: Callable[[str], str], categories: dict[str, str], task: str, batch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def one(keys: list[str], texts: list[str]) -> pa.RecordBatch:
        try:
            response = ask(prompt(texts, categories, task))
        except Exception:  # noqa: BLE001 - whatever a model's client raises, the rule answers
            response = None
        return pa.RecordBatch.from_arrays([pa.array([keys]), pa.array([texts]), pa.array([response], pa.string())], names=["keys", "texts", "response"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts = [], []
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                keys.append(key)
                texts.append(text)
                if len(keys) == batch:
                    yield one(keys, texts)
                    keys, texts = [], []
        if keys:
            yield one(keys, texts)

    return run


def classified_texts(df: DataFrame, column: str, ask: Callable[[str], str], categories: dict[str, str], cache: str, rule: Callable[[Column], Column], task: str = "title", model: str = "model", batch: int = 20, again: bool = False) -> DataFrame:
    """`df` with `label` and `origin` (model, rule, or none for a null text, whose label is null).

    `ask` takes a prompt and gives the response; it runs in executors, once per `batch` distinct texts that the table at
    `cache` (a shared path) doesn't hold yet for this model, task and set of categories. A text that the response leaves out or
    puts into no known category, and all texts of a batch whose call fails, are labelled by `rule`. All answers are appended to
    the cache before they are used, so a second run asks nothing; with `again` texts that the rule labelled are asked anew and a
    model's answer goes before a rule's. A task that runs again after a lost executor asks again: calls happen at least once.

    Answers meet rows by the hash of the text: equal texts are one row of the cache, however many rows of `df` hold them."""
    spark = df.sparkSession
    keyed = df.withColumn("_key", cache_key(F.col(column), categories, task, model)).withColumn("_key", F.when(F.col(column).isNotNull(), F.col("_key")))
    known = opened(spark, cache, CACHE)
    settled = known.where("origin = 'model'") if again else known
    distinct = keyed.where("_key IS NOT NULL").groupBy(F.col("_key").alias("key")).agg(F.first(column).alias("text"))
    misses = distinct.join(settled.select("key"), "key", "left_anti")
    asked = misses.mapInArrow(_ask(ask, categories, task, batch), ASKED)
    rows = asked.select("response", F.posexplode(F.arrays_zip("keys", "texts")).alias("i", "x"))
    label = numbered_answers(F.col("response"), F.col("i") + 1, list(categories))
    found = rows.select(F.col("x.keys").alias("key"), label.alias("said"), F.col("x.texts").alias("text"))
    found.select("key", F.coalesce("said", rule(F.col("text"))).alias("label"), F.when(F.col("said").isNull(), "rule").otherwise("model").alias("origin")).write.mode("append").parquet(cache)

    best = opened(spark, cache, CACHE).groupBy("key").agg(F.min(F.struct("origin", "label")).alias("_a"))
    answered = keyed.where("_key IS NOT NULL").join(best.withColumnRenamed("key", "_key"), "_key")
    none = keyed.where("_key IS NULL").select(*df.columns, F.lit(None).cast("string").alias("label"), F.lit("none").alias("origin"))
    return answered.select(*df.columns, F.col("_a.label").alias("label"), F.col("_a.origin").alias("origin")).unionAll(none)
