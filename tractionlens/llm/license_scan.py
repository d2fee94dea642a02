"""License scans by diagonal voting on DataFrame functions only: word k-grams meet template positions, diagonals are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractionlens.llm.shared import table

K = 3
SPOKEN = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose every whole occurrence counts. Fixed values.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Openings of public licenses and of the notices that refer to them. Fixed values.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)
#: Places a template may have at most, so that votes fit four numbers of 64 bits.
MOST = 256


def template_grams(phrases: tuple, templates: tuple, k: int = K, share: float = 0.7, whole: int = 12) -> list[tuple]:
    """(template, label, base, grams, needed, place, gram) for every k-gram of every template. All k-grams of a phrase or of a
    template of at most `whole` are needed, else `share` of them."""
    out = []
    for number, (base, (label, text)) in enumerate([(True, x) for x in phrases] + [(False, x) for x in templates]):
        words = text.split()
        n = len(words) - k + 1
        if not 1 <= n <= MOST:
            raise ValueError(f"a template has {k} to {MOST + k - 1} words: {text[:60]}")
        needed = n if base or n <= whole else -int(-share * n // 1)
        out += [(number, label, base, n, needed, i, " ".join(words[i : i + k])) for i in range(n)]
    return out


def _bits(column: Column, number: int) -> Column:
    """The votes for places 64 * number on as bits."""
    inside = F.floor(column / 64) == number
    return F.when(inside, F.call_function("shiftleft", F.lit(1).cast("long"), (column % 64).cast("int"))).otherwise(0)


def license_scan(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, k: int = K, share: float = 0.7, width: int = 8) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of digits, ASCII letters (only A-Z lower-cased) and characters beyond ASCII; a null text has none. Every
    place where a phrase of `phrases` stands is counted: n_base, its smallest and largest word (null without any), its labels.
    `labels` adds those of templates found: at least `share` of a template's k-grams, in any words between (all of them for
    short templates). Labels are distinct, sorted, joined by commas; none is ''. score is the largest part of a phrase's or
    template's k-grams found in one place, 0 to 1. spans: (label, first word, last word, score) of what is found.

    Repeated rows, rows without doc_id and equal texts are separate rows. An empty table gives no rows. Only doc_id and text are
    read. A very long text is one task's, as rows of its words; only its votes move.

    All k-grams of all texts meet the templates' k-grams by hash, and the words are compared where hashes agree; the templates are a
    parameter of at most MOST places each, so their table is broadcast. A vote is for a diagonal (word in the text less place in the
    template). A phrase stands where a diagonal has all votes. For templates, diagonals that lie in a band of 2 * `width` are
    merged, so that words put in or left out don't part the votes; each band overlaps the next by half. Votes are kept as
    bits of the template's places: merging is `or`, and the span is verified by the places that are covered."""
    spark = docs.sparkSession
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    spoken = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.regexp_extract_all(text, F.lit(SPOKEN), F.lit(1)).alias("words"))
    gram = lambda w, i: F.concat_ws(" ", w, *[F.get("words", i + j) for j in range(1, k)])
    grams = F.when(F.size("words") >= k, F.slice(F.transform("words", gram), F.lit(1), F.size("words") - (k - 1)))
    every = spoken.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), grams.alias("grams"))
    every = every.select("row", "doc_id", "n_words", F.posexplode_outer("grams").alias("at", "gram")).withColumn("h", F.xxhash64("gram"))

    places = spark.createDataFrame(template_grams(phrases, templates, k, share), "template int, label string, base boolean, grams int, needed int, place int, t_gram string")
    places = places.withColumn("t_h", F.xxhash64("t_gram"))
    votes = every.join(F.broadcast(places), (F.col("h") == F.col("t_h")) & (F.col("gram") == F.col("t_gram")), "left")
    # a text without votes stays as its first row
    votes = votes.where("template IS NOT NULL OR at IS NULL OR at = 0").select("row", "doc_id", "n_words", "template", "label", "base", "grams", "needed", "place", (F.col("at") - F.col("place")).alias("diagonal"))

    bits = [f"bits{i}" for i in range(MOST // 64)]
    own = ["row", "doc_id", "n_words", "template", "label", "base", "grams", "needed"]
    found = votes.repartition("row").groupBy(*own, "diagonal").agg(*[F.bit_or(_bits(F.col("place"), i)).alias(b) for i, b in enumerate(bits)], F.min("place").alias("low"), F.max("place").alias("high"))
    band = F.floor(F.col("diagonal") / width)
    bands = F.when(F.col("base") | F.col("template").isNull(), F.array("diagonal")).otherwise(F.array((band - 1).cast("int"), band.cast("int")))
    banded = found.select(*own, *bits, (F.col("diagonal") + F.col("low")).alias("first"), (F.col("diagonal") + F.col("high") + k - 1).alias("last"), F.explode(bands).alias("band"))
    merged = banded.groupBy(*own, "band").agg(*[F.bit_or(b).alias(b) for b in bits], F.min("first").alias("first"), F.max("last").alias("last"))
    covered = sum((F.bit_count(b) for b in bits[1:]), F.bit_count(bits[0]))
    merged = merged.withColumn("covered", covered).withColumn("part", F.col("covered") / F.col("grams"))

    hit = F.coalesce(F.col("covered") >= F.col("needed"), F.lit(False))
    stands = hit & F.col("base")
    listed = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    span = F.struct("label", F.col("first").cast("long").alias("first_word"), F.col("last").cast("long").alias("last_word"), F.col("part").alias("score"))
    out = merged.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(stands).alias("n_base"),
        F.min(F.when(stands, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(stands, F.col("first"))).cast("long").alias("last_word"),
        listed(stands).alias("base_labels"),
        listed(hit).alias("labels"),
        F.coalesce(F.max("part"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set(F.when(hit, span))).alias("spans"),
    )
    return out.drop("row")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def _oracle() -> str:
    quote = lambda x: "'" + x + "'" if isinstance(x, str) else str(x).lower()
    rows = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in template_grams(PHRASES, TEMPLATES))
    return f"""WITH t(template, label, base, grams, needed, place, gram) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPOKEN[1:-1]}') AS w FROM documents),
g AS (SELECT id, unnest(list_transform(range(1, len(w) - {K - 2}), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram, unnest(range(len(w) - {K - 1})) AS pos FROM d WHERE len(w) >= {K}),
v AS (SELECT id, template, label, base, grams, needed, place, pos - place AS diagonal FROM g JOIN t USING (gram)),
b AS (SELECT *, unnest(CASE WHEN base THEN [diagonal] ELSE [CAST(floor(diagonal / 8) AS BIGINT), CAST(floor(diagonal / 8) AS BIGINT) - 1] END) AS band FROM v),
m AS (SELECT id, label, base, count(DISTINCT place) >= needed AS hit, count(DISTINCT place) / grams AS part, min(diagonal + place) AS first FROM b GROUP BY id, template, label, base, grams, needed, band),
r AS (SELECT id, count(*) FILTER (base AND hit) AS n_base, min(first) FILTER (base AND hit) AS first_word, max(first) FILTER (base AND hit) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND hit) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (hit) AS labels, max(part) AS score FROM m GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN r USING (id)"""


QUERIES = {"op11_license_scan": op11_license_scan}
ORACLES = {"op11_license_scan": _oracle()}
