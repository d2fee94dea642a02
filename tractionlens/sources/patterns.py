"""Pattern documents: JSON with a nested schema, read with the drift that older files have, and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = (
    "pattern_id string, name string, description string, applicable_subreddits array<string>, title_template string, body_structure_template string, historical_viral_rate double, "
    "confidence_interval array<double>, avg_upvotes double, p_value double, exemplar_posts array<string>, hook_type string, narrative_mode string, "
    "recommended_metrics map<string, array<long>>, tier_effectiveness map<string, double>, sample_size long, success_rate double, feedback_sample_size long, last_evaluated_at string, status string"
)
ANTI_PATTERN = "pattern_id string, name string, description string, failure_rate double, exemplar_posts array<string>, why_it_fails string, sample_size long"
#: Keys of a saved draft check in older documents.
CHECK_KEYS = {"passed": "是否通过", "dimensions": "各维度", "suggestions": "改进建议"}
CHECK = "passed boolean, dimensions map<string, double>, suggestions array<string>"


def _fields(schema: str) -> list[tuple[str, str]]:
    """(name, type) of a schema in one line; commas inside angle brackets belong to a type."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(tuple(schema[start:i].strip().split(" ", 1)))
            start = i + 1
    return out


def read_documents(spark: SparkSession, path: str, schema: str = PATTERN) -> DataFrame:
    """One row per object of the JSON files at `path`, each a list of objects, one object, or lines of objects.

    Absent fields are null, unknown ones are dropped, a field of another type than the schema's is null and leaves the rest of
    its object whole. A file that is no JSON gives no rows."""
    files = spark.read.text(path, wholetext=True)
    whole = F.try_parse_json("value")
    lines = F.transform(F.filter(F.split("value", r"\n"), lambda x: F.trim(x) != ""), lambda x: F.try_parse_json(x))
    # a parser stops after the first value, so lines are told by a first line that is an object of its own
    by_line = F.startswith(F.ltrim("value"), F.lit("{")) & F.get(lines, 0).isNotNull()
    objects = F.when(by_line, lines).otherwise(F.coalesce(F.try_variant_get(whole, "$", "array<variant>"), F.array(whole)))
    rows = files.select(F.explode(objects).alias("_v")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    return rows.select(*[F.try_variant_get("_v", f"$.{name}", kind).alias(name) for name, kind in _fields(schema)])


def with_defaults(patterns: DataFrame) -> DataFrame:
    """Pattern documents as the other operators take them: status active, rates and samples 0, lists and maps empty where absent."""
    empty = {"applicable_subreddits": "array<string>", "exemplar_posts": "array<string>"}
    zero = {"historical_viral_rate": 0.0, "avg_upvotes": 0.0, "sample_size": 0, "success_rate": 0.0, "feedback_sample_size": 0}
    out = {k: F.coalesce(k, F.array().cast(t)) for k, t in empty.items()}
    out |= {k: F.coalesce(k, F.lit(v).cast("double" if isinstance(v, float) else "long")) for k, v in zero.items()}
    out |= {"status": F.coalesce("status", F.lit("active")), "title_template": F.coalesce("title_template", F.lit("")), "p_value": F.coalesce("p_value", F.lit(1.0))}
    return patterns.withColumns(out)


def metric_range(name: str) -> tuple[Column, Column]:
    """Both ends of a recommended range, null without one."""
    pair = F.try_element_at("recommended_metrics", F.lit(name))
    return F.get(pair, 0), F.get(pair, 1)


def write_documents(df: DataFrame, path: str) -> None:
    """Lines of JSON objects in the folder `path`; null fields are left out, nested ones keep their form."""
    df.write.mode("overwrite").json(path)


def draft_checks(documents: DataFrame, column: str = "self_check") -> DataFrame:
    """`documents` with the struct `check` (passed, dimensions, suggestions) from a JSON text column whose keys are English or, in
    older documents, Chinese. A text that is no JSON object gives null fields."""
    v = F.try_parse_json(column)
    fields = [F.coalesce(*[F.try_variant_get(v, f"$['{key}']", kind) for key in (name, CHECK_KEYS[name])]).alias(name) for name, kind in _fields(CHECK)]
    return documents.withColumn("check", F.struct(*fields))


def utc_times(df: DataFrame, *columns: str) -> DataFrame:
    """ISO times in text as timestamps; one without an offset is taken as UTC, one that can't be read is null."""
    def at(name: str) -> Column:
        text = F.trim(F.col(name))
        return F.coalesce(F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text)), F.try_to_timestamp(F.concat(text, F.lit("Z"))))

    return df.withColumns({name: at(name) for name in columns})
