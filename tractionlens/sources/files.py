"""Posts from landed files, JSON lines, keyed upserts and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Accepted column names of each field, first match wins.
ALIASES: dict[str, tuple[str, ...]] = {
    "id": ("id", "post_id", "submission_id", "name"),
    "subreddit": ("subreddit", "subreddit_name", "sub"),
    "title": ("title", "post_title"),
    "body": ("selftext", "body", "text", "content", "post_body"),
    "author": ("author", "author_name", "username", "user"),
    "created_utc": ("created_utc", "created", "timestamp", "created_at", "date"),
    "upvotes": ("score", "upvotes", "ups", "points", "net_upvotes"),
    "upvote_ratio": ("upvote_ratio", "ratio", "up_ratio"),
    "num_comments": ("num_comments", "comments", "comment_count", "n_comments"),
    "flair": ("link_flair_text", "flair", "post_flair"),
    "is_oc": ("is_oc", "oc", "original_content"),
    "is_nsfw": ("over_18", "nsfw", "is_nsfw"),
    "url": ("url", "permalink", "link"),
}
# Marks of media in a lower-cased url.
IMAGE_MARKS = (".jpg", ".png", ".gif", "imgur.com", "i.redd.it")
MOVING_MARKS = (".gif", "gfycat")
VIDEO_MARKS = ("youtube.com", "youtu.be", "v.redd.it")


def read_delimited(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Text columns of a delimited file with a header; the delimiter is the most frequent of comma, tab, semicolon and bar in the
    header. Malformed rows go; gzip is told by the suffix. Line breaks inside quotes need `multi_line`, which reads a file in
    one task: turn it off for large files without them."""
    head = spark.read.text(path).first()
    header = head["value"] if head else ""
    sep = max(",\t;|", key=header.count)
    return spark.read.csv(path, sep=sep, header=True, mode="DROPMALFORMED", multiLine=multi_line, escape='"')


def detect_schema(columns: list[str]) -> dict[str, str]:
    """Field -> the column that holds it; names are compared without case and outer spaces."""
    known = {}
    for c in columns:
        known.setdefault(c.strip().lower(), c)
    picked = {field: next((known[n] for n in names if n in known), None) for field, names in ALIASES.items()}
    return {field: c for field, c in picked.items() if c is not None}


def _has(url: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(F.lower(url), F.lit(m))
    return found


def media_type(url: Column, rules: str, is_self: Column, is_video: Column, hint: Column) -> Column:
    """text, image, video or link by the rules of a table, a dump or an archive; an absent url is an empty one."""
    if rules == "table":
        out = F.when(_has(url, IMAGE_MARKS), F.when(_has(url, MOVING_MARKS), "video").otherwise("image")).when(_has(url, VIDEO_MARKS), "video").when(F.startswith(url, F.lit("http")), "link")
    elif rules == "dump":
        out = F.when(is_video, "video").when(~is_self & _has(url, IMAGE_MARKS), "image").when(~is_self & F.startswith(url, F.lit("http")), "link")
    elif rules == "archive":
        out = F.when((hint == "image") | _has(url, IMAGE_MARKS), "image").when((hint == "hosted:video") | F.contains(url, F.lit("v.redd.it")), "video").when((url != "") & ~is_self, "link")
    else:
        raise ValueError(f"no such rules: {rules}")
    return out.otherwise("text")


def normalized(raw: DataFrame, rules: str = "table", dataset: str = "files", strict: bool = True) -> DataFrame:
    """Posts from any frame with known column names.

    Absent fields take defaults. Times are epoch seconds or text, else null. A number that can't be read drops its row if
    `strict`, else counts as 0. Empty ids stay empty."""
    at = detect_schema(raw.columns)
    names = {c.lower(): c for c in raw.columns}

    def text(column: str | None) -> Column:
        return F.nullif(F.col(f"`{column}`").cast("string"), F.lit("")) if column else F.lit(None).cast("string")

    def number(field: str) -> Column:
        value = F.lower(F.trim(text(at.get(field))))
        return F.when(value.isin("true", "yes"), 1.0).when(value.isin("false", "no"), 0.0).otherwise(value.try_cast("double"))

    def flag(name: str, default: bool) -> Column:
        return F.coalesce(F.lower(F.trim(text(names.get(name)))).isin("true", "1", "yes"), F.lit(default))

    numeric = ["upvotes", "upvote_ratio", "num_comments", "is_oc", "is_nsfw"]
    if strict:
        for field in numeric:
            given = text(at.get(field))
            raw = raw.where(given.isNull() | (F.trim(given) == "") | number(field).isNotNull())
    value = {field: F.coalesce(number(field), F.lit(0.0)) for field in numeric}
    created, ident, url = text(at.get("created_utc")), F.coalesce(text(at.get("id")), F.lit("")), F.coalesce(text(at.get("url")), F.lit(""))
    return raw.select(
        F.when((ident == "") | F.startswith(ident, F.lit("t3_")), ident).otherwise(F.concat(F.lit("t3_"), ident)).alias("post_id"),
        F.replace(F.coalesce(text(at.get("subreddit")), F.lit("unknown")), F.lit("r/"), F.lit("")).alias("subreddit"),
        F.coalesce(text(at.get("title")), F.lit("")).alias("title"),
        F.coalesce(text(at.get("body")), F.lit("")).alias("body"),
        F.coalesce(text(at.get("author")), F.lit("[deleted]")).alias("author"),
        F.coalesce(F.timestamp_seconds(created.try_cast("double")), F.try_to_timestamp(created)).alias("created_utc"),
        value["upvotes"].cast("long").alias("upvotes"),
        value["upvote_ratio"].alias("upvote_ratio"),
        value["num_comments"].cast("long").alias("num_comments"),
        text(at.get("flair")).alias("flair"),
        (value["is_oc"] != 0).alias("is_oc"),
        (value["is_nsfw"] != 0).alias("is_nsfw"),
        media_type(url, rules, flag("is_self", True), flag("is_video", False), F.coalesce(text(names.get("post_hint")), F.lit(""))).alias("content_type"),
        F.nullif(url, F.lit("")).alias("url"),
        F.lit(dataset).alias("source_dataset"),
    )


def read_crossrefs(spark: SparkSession, path: str) -> DataFrame:
    """Source community and target post of a tab-separated file; lines from # on and rows with one field go."""
    df = spark.read.csv(path, sep="\t", comment="#", schema="source_subreddit string, target_post_id string")
    return df.where("source_subreddit IS NOT NULL AND target_post_id IS NOT NULL")


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, lines that are no JSON of the schema); empty lines belong to neither."""
    name = "_corrupt_record"
    lines = spark.read.text(path).where(F.trim("value") != "")
    whole = StructType([*schema.fields, StructField(name, StringType())])
    parsed = lines.select("value", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": name}).alias("row"))
    bad = F.col("row").isNull() | F.col(f"row.{name}").isNotNull()
    return parsed.where(~bad).select(*[F.col("row")[f].alias(f) for f in schema.names]), parsed.where(bad).select("value")


def write_jsonl(df: DataFrame, path: str, append: bool = False, compress: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("compression", "gzip" if compress else "none").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row per JSON file of a folder, newest file first; unreadable files go."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    at = df.select("*", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file"))
    return at.orderBy(F.desc("modified"), "file")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same keys; of rows of `new` with equal keys the one highest by `order` stays."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), F.col(order)).alias("row")).select("row.*")
    return old.join(last, keys, "left_anti").unionByName(last, allowMissingColumns=True)


def export(posts: DataFrame, comments: DataFrame, crossrefs: DataFrame, path: str) -> None:
    """Parquet tables of a collection; posts in folders by tier."""
    posts.write.mode("overwrite").partitionBy("tier").parquet(f"{path}/posts")
    comments.write.mode("overwrite").parquet(f"{path}/comments")
    crossrefs.write.mode("overwrite").parquet(f"{path}/crossrefs")
