"""The whole analysis for all posts, every tier and every community from one pass: measures are counted by value, levels add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractionlens.functions import special as Z
from tractionlens.functions import text as T
from tractionlens.operators import analysis as A
from tractionlens.sources.storage import written

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def title_measures() -> dict[str, Column]:
    t = F.col("title")
    upper = (F.upper(t) == t) & (F.lower(t) != t)
    flags = A.title_flags() | {"all_caps": upper & (F.length(t) > 10), "mixed_case": t.rlike(r"\p{Lu}") & ~upper, "temporal": T.has_any(F.lower(t), T.TIME_WORDS)}
    numbers = {"char_count": F.length(t), "word_count": T.n_words(t), "intensity": F.round(T.intensity(t) * 10)}
    structure = F.concat_ws("|", *[F.when(x, k).otherwise("") for k, x in A.template_flags().items()])
    return {**numbers, **flags, "hook": T.hook_type(t), "polarity": T.polarity(t), "structure": structure}


def body_measures() -> dict[str, Column]:
    """Measures of `body`; `_read` holds its readability(), which two of them name."""
    b, read = F.col("body"), F.col("_read")
    numbers = {"word_count": T.n_words(b), "paragraph_count": F.regexp_count(b, F.lit("\n\n")) + 1, "grade": F.round(read["grade"] * 100), "ease": F.round(read["ease"] * 100)}
    return {**numbers, **A.body_flags(), "engaging": T.calls_to_answer(b), "narrative": T.narrative_mode(b, with_no_body=False), "opening": T.opening(b)}


def meta_measures() -> dict[str, Column]:
    flaired = F.coalesce(F.col("flair") != "", F.lit(False))
    debated = F.coalesce(F.expr("upvote_ratio > 0 AND upvote_ratio < 0.75 AND num_comments > 0"), F.lit(False))
    slots = {"day": F.date_format("created_utc", "E"), "hour": F.date_format("created_utc", "HH")}
    return {"flaired": flaired, "controversial": debated, "flair": F.when(flaired, F.lower("flair")), "media": F.col("content_type"), **slots}


#: Part -> (which posts it takes, its measures, the names of those that are numbers, of those that are flags). The rest are classes.
PARTS = {
    "title": (lambda: F.col("title") != "", title_measures, ("char_count", "word_count", "intensity"), ("colon", "dash", "parenthesis", "number", "question", "all_caps", "mixed_case", "temporal")),
    "body": (lambda: F.length("body") >= 20, body_measures, ("word_count", "paragraph_count", "grade", "ease"), ("list", "tldr", "bold", "quote", "ending_question", "call_to_action", "engaging")),
    "meta": (lambda: F.lit(True), meta_measures, (), ("flaired", "controversial")),
}


def measure_cube(posts: DataFrame) -> DataFrame:
    """(tier, subreddit, part, measure, kind, value, number, n, u, uu, c, cc): posts by the value of each measure, with sums of
    scores and comments and of their squares. Numbers and flags (0, 1) are in `number`, classes in `value`.

    A post is one row until the map side of the count, which meets few distinct values. What is left is as large as the distinct
    values by community, whatever the number of posts."""
    entries, posts = [], posts.withColumn("_read", T.readability(F.col("body")))
    for part, (taken, measures, numbers, flags) in PARTS.items():
        found = [
            F.struct(
                F.lit(part).alias("part"),
                F.lit(name).alias("measure"),
                F.lit("number" if name in numbers else "flag" if name in flags else "class").alias("kind"),
                F.lit(None).cast("string").alias("value") if name in numbers + flags else x.cast("string").alias("value"),
                x.cast("int").cast("long").alias("number") if name in flags else (x.cast("long") if name in numbers else F.lit(None).cast("long")).alias("number"),
            )
            for name, x in measures().items()
        ]
        entries.append(F.when(taken(), F.array(*found)).otherwise(F.array().cast("array<struct<part:string,measure:string,kind:string,value:string,number:bigint>>")))
    u, k = F.col("upvotes"), F.col("num_comments")
    rows = posts.select("tier", F.lower("subreddit").alias("subreddit"), "upvotes", "num_comments", F.inline(F.concat(*entries)))
    rows = rows.where("kind <> 'class' OR value IS NOT NULL")
    return rows.groupBy("tier", "subreddit", "part", "measure", "kind", "value", "number").agg(F.count("*").alias("n"), F.sum(u).alias("u"), F.sum(u * u).alias("uu"), F.sum(k).alias("c"), F.sum(k * k).alias("cc"))


def levels(cube: DataFrame) -> DataFrame:
    """The cube for all posts, by tier and by community: level, key and the summed columns. Posts without a tier are in no tier."""
    own = ["part", "measure", "kind", "value", "number"]
    sets = [own, ["tier", *own], ["subreddit", *own]]
    out = cube.groupingSets(sets, "tier", "subreddit", *own).agg(*[F.sum(x).alias(x) for x in ("n", "u", "uu", "c", "cc")], F.grouping("tier").alias("_t"), F.grouping("subreddit").alias("_s"))
    level = F.when(F.col("_t") == 0, "tier").when(F.col("_s") == 0, "subreddit").otherwise("all")
    return out.select(level.alias("level"), F.when(level == "all", "all").when(level == "tier", F.col("tier")).otherwise(F.col("subreddit")).alias("key"), *own, "n", "u", "uu", "c", "cc").where("key IS NOT NULL")


def _long(df: DataFrame, statistics: dict[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("statistic"), v.cast("double").alias("amount")) for k, v in statistics.items()])
    return df.select("level", "key", "part", "measure", "value", F.inline(rows)).where("amount IS NOT NULL")


def _r(y: str) -> Column:
    """Pearson's r of `number` and y (sum y, sum of squares yy, sum of products ny) from sums over counted values; 0 under ten."""
    n, sx, sxx, sy, syy, sxy = (F.col(x).cast("double") for x in ("n", "x", "xx", y, y * 2, f"x{y}"))
    spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.when((n < 10) | (spread <= 0), 0.0).otherwise((n * sxy - sx * sy) / F.sqrt(n * sxx - sx * sx) / F.sqrt(n * syy - sy * sy))


def statistics(counted: DataFrame) -> DataFrame:
    """(level, key, part, measure, value, statistic, amount) of levels().

    Numbers: n, mean, std, p10 to p99, r and p against the score (bodies' `engaging` against comments). Flags: rate, and gain, the
    mean score with less that without (0 where one side is empty). Classes, per value: n, share, avg_upvotes, std."""
    by = ["level", "key", "part", "measure"]
    x = F.col("number")
    sums = [F.sum(e).alias(a) for a, e in {"x": x * F.col("n"), "xx": x * x * F.col("n"), "xu": x * F.col("u"), "xc": x * F.col("c"), "u": F.col("u"), "uu": F.col("uu"), "c": F.col("c"), "cc": F.col("cc")}.items()]
    q = F.percentile(x, F.array(*[F.lit(p) for p in QUANTILES]), F.col("n")).alias("q")
    numbers = counted.where("kind = 'number'").groupBy(*by).agg(*sums, q, F.sum("n").alias("n")).withColumn("value", F.lit(None).cast("string"))
    numbers = numbers.withColumn("r", _r("u"))
    found = {"n": F.col("n"), "mean": A._d("x") / A._d("n"), "std": A.deviation(F.col("n"), F.col("x"), F.col("xx")), **{f"p{round(p * 100)}": F.col("q")[i] for i, p in enumerate(QUANTILES)}, "r": F.col("r"), "p": Z.correlation_p(F.col("r"), F.col("n"))}
    out = _long(numbers, found)

    on, off = x == 1, x == 0
    flags = counted.where("kind = 'flag'").groupBy(*by).agg(*sums, F.sum("n").alias("n"), *[F.sum(F.when(test, F.col(k))).alias(f"{k}{i}") for i, test in ((1, on), (0, off)) for k in ("n", "u")]).withColumn("value", F.lit(None).cast("string"))
    gain = F.coalesce(A._d("u1") / A._d("n1") - A._d("u0") / A._d("n0"), F.lit(0.0))
    flags = flags.withColumn("r", F.when((F.col("part") == "body") & (F.col("measure") == "engaging"), _r("c")))
    out = out.unionByName(_long(flags, {"n": F.col("n"), "rate": F.coalesce(A._d("n1"), F.lit(0.0)) / A._d("n"), "gain": gain, "r": F.col("r"), "p": Z.correlation_p(F.col("r"), F.col("n"))}))

    classes = counted.where("kind = 'class'")
    whole = classes.groupBy(*by).agg(F.sum("n").alias("_all"))
    classes = classes.join(whole, by)
    return out.unionByName(_long(classes, {"n": F.col("n"), "share": A._d("n") / A._d("_all"), "avg_upvotes": A._d("u") / A._d("n"), "std": A.deviation(F.col("n"), F.col("u"), F.col("uu"))}))


def analyzed(posts: DataFrame) -> DataFrame:
    """statistics() of all levels. Posts are read once; the cube is a table in the shared folder."""
    return statistics(written(levels(measure_cube(posts)), "levels"))
