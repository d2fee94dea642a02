"""Line-first cleaning, on DataFrame functions only: rules judge lines, failing lines go, documents that lose too much go."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractionlens.llm.shared import table, words

SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TERMINAL = r"[.!?:;\"'»”…)\]]\s*$"
NAVIGATION = r"(?i)(^\s*(home|menu|next|previous|back|login|log in|sign in|sign up|search|share|tweet|skip to content|read more|click here|see also|contact us|about us|site map|sitemap)\b.{0,24}$)|([|»›•].*[|»›•].*[|»›•])"
BOILERPLATE = r"(?i)(all rights reserved|copyright \(c\)|©|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|enable javascript|subscribe to our newsletter|powered by|lorem ipsum|licensed under|released under)"


#: What a text must hold, lower-cased, for a line of it to be boilerplate or navigation by separators; and the most
#: characters other than white space that a line with a navigation word has.
MARKS = ("all rights reserved", "copyright (c)", "©", "terms of ", "privacy policy", "cookie", "enable javascript", "subscribe to our newsletter", "powered by", "lorem ipsum", "licensed under", "released under", "|", "»", "›", "•")
NAVIGATION_CHARS = 39


def line_fails(line: Column, words: Column, max_punctuation: float, min_open_words: int, marked: bool = True) -> Column:
    """A line with a word fails if it has more than `max_punctuation` ASCII punctuation marks a word, is navigation or
    boilerplate, or has under `min_open_words` words and no closing punctuation. A line without a word never fails.

    With `marked` off, for lines of texts without any of MARKS, only short lines meet a pattern."""
    n = F.size(words)
    few = n < min_open_words
    bad = F.regexp_count(line, F.lit(f"[{re.escape(PUNCTUATION)}]")) > n * max_punctuation
    if marked:
        bad = bad | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)
    else:
        bad = bad | ((F.length(F.array_join(words, "")) <= NAVIGATION_CHARS) & line.rlike(NAVIGATION))
    return (n > 0) & (bad | (few & ~line.rlike(TERMINAL)))


def quality_rules(
    docs: DataFrame,
    max_punctuation: float = 1.0,
    min_open_words: int = 3,
    max_lost: float = 0.5,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, text, clean_text, n_lines, n_failed_lines, the base counts, base_failed, kept.

    Verdict: kept if not base_failed and the failed lines hold at most `max_lost` of the characters (without white
    space) of all lines. Null or empty text: no words, base_failed, not kept, clean_text ''. Repeated rows are judged
    each by itself; an empty table gives no rows; only doc_id and text are read, so other columns may have any name. A text's
    lines, words and windows are arrays of its row, so a very long text takes memory in proportion to its words. No shuffle: every rule sees one row.
    `carry` adds the input row as the struct column input_row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = [F.struct("*").alias("input_row")] if carry else []
    df = docs.select("doc_id", text.alias("text"), *carried)
    joined = lambda ws: F.length(F.array_join(ws, ""))
    df = df.withColumn("_lines", F.transform(F.split("text", "\n", -1), lambda line: F.struct(line.alias("line"), words(line).alias("ws"))))

    def judged(marked: bool) -> Column:
        bad = lambda x: line_fails(x["line"], x["ws"], max_punctuation, min_open_words, marked)
        return F.transform("_lines", lambda x: F.struct(x["line"].alias("line"), bad(x).alias("bad"), (F.size(x["ws"]) > 0).alias("full"), joined(x["ws"]).alias("solid")))

    low = F.lower("text")
    any_mark = F.contains(low, F.lit(MARKS[0]))
    for mark in MARKS[1:]:
        any_mark = any_mark | F.contains(low, F.lit(mark))
    df = df.withColumns({"_words": F.flatten(F.transform("_lines", lambda x: x["ws"])), "_judged": F.when(any_mark, judged(True)).otherwise(judged(False))})
    # most texts repeat no window: only the others sort theirs, with their places
    triple = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    df = df.withColumn("_windows", F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), triple)))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(twice, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("_sorted", lambda x, j: (F.get("_sorted", j - 1)["h"] == x["h"]) | (F.get("_sorted", j + 1)["h"] == x["h"]))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(places, none, lambda a, i: F.struct((a["n"] + 3 - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + 3).alias("end")))["n"]
    full = F.filter("_judged", lambda x: x["full"])
    failing = F.filter("_judged", lambda x: x["bad"])
    counts = (
        F.array_join(F.transform(F.filter("_judged", lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("clean_text"),
        F.size("_words").cast("long").alias("n_words"),
        joined("_words").cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{re.escape(SYMBOLS)}]")).cast("long").alias("n_symbols"),
        (F.size(full) - F.size(F.array_distinct(F.transform(full, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(full).cast("long").alias("n_lines"),
        F.size(failing).cast("long").alias("n_failed_lines"),
        F.aggregate(failing, F.lit(0), lambda a, x: a + x["solid"]).cast("long").alias("lost_chars"),
    )
    # a generator over one row: a filter on the counts then stays above it, and the rules run once
    df = df.select("doc_id", "text", *(["input_row"] if carry else []), F.inline(F.array(F.struct(*counts))))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.col("word_chars") * max_lost))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.drop("text", "clean_text")


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    w = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {w.format("text")} AS ws, string_split(text, chr(10)) AS lines FROM d),
g AS (SELECT doc_id, i, list_extract(ws, i) AS a, list_extract(ws, i + 1) AS b, list_extract(ws, i + 2) AS c
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
l AS (SELECT doc_id, line, len({w.format("line")}) AS n, length(line) - length(translate(line, '{q(PUNCTUATION)}', '')) AS marks
      FROM (SELECT doc_id, unnest(lines) AS line FROM w)),
j AS (SELECT doc_id, line, n, (marks > n * 1.0 OR regexp_matches(line, '{q(NAVIGATION)}') OR regexp_matches(line, '{q(BOILERPLATE)}')
        OR (n < 3 AND NOT regexp_matches(line, '{q(TERMINAL)}'))) AS bad FROM l WHERE n > 0),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad) AS n_failed_lines,
        coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (bad), 0) AS lost_chars FROM j GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(t.n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(t.n_lines, 0)::BIGINT AS n_lines,
        coalesce(t.n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(t.lost_chars, 0)::BIGINT AS lost_chars
      FROM w LEFT JOIN t USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= word_chars * 0.5 AS kept FROM s"""


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES = {"op3_quality_rules": _sql()}
