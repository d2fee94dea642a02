"""Each registered query against its SQL on the smallest tables, and literal cases of the building blocks."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tractionlens.functions import text as T
from tractionlens.operators import analysis as A
from tractionlens.operators import feedback as B
from tractionlens.operators import mining as M
from tractionlens.operators import selection as R
from tractionlens.operators import validation as V
from tractionlens.functions import drafts as D
from tractionlens.plans import analyses, checks, intervals, jobs, more, registry  # noqa: F401

from tractionlens.sources import posts as S

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents events pages conversations labels benchmark".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(round(float(v), 9) if isinstance(v, (int, float)) and v == v else str(v) for v in r) for r in frame[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    assert _rows(registry.QUERIES[name](spark, SF).toPandas()) == _rows(duck.execute(registry.ORACLES[name]).df())


def test_performance_bounds(spark):
    cases = [(1000, 50, "super_viral"), (500, 50, "super_viral"), (150, 50, "viral"), (75, 50, "passing"), (30, 50, "failed"), (0, 0, "failed"), (10, 0, "passing")]
    df = spark.createDataFrame(cases, "u long, m long, want string")
    assert df.where(T.performance(F.col("u"), F.col("m")) != F.col("want")).count() == 0


def test_yates(spark):
    x = spark.range(1).select(M.chi_square(F.lit(20), F.lit(10), F.lit(10), F.lit(20)).alias("x")).first()["x"]
    assert abs(x - 5.4) < 1e-12


def test_hook_rules(spark):
    long = "and then one day i went to the market to see what was for sale there"
    cases = [
        ("Is it?", "curious_question"), ("Is it 3?", "number_shock"), ("cats vs dogs", "comparison_analysis"), ("how to cook", "tutorial_howto"), ("tired of rules", "pain_point"),
        ("my journey as a cook", "identity_label"), ("free tool", "resource_share"), ("see 3 cats", "number_shock"), (long, "story_opener"), ("plain", "curious_question"), ("hot take", "controversial_opinion"),
    ]
    df = spark.createDataFrame(cases, "t string, want string").withColumn("got", T.hook_type(F.col("t")))
    assert [tuple(r) for r in df.where("got <> want").collect()] == []


def test_narrative_order(spark):
    body = "x" * 210 + " my end?"
    df = spark.createDataFrame([(body,)], "b string")
    r = df.select(T.narrative_mode(F.col("b")).alias("a"), T.narrative_mode(F.col("b"), story_first=True).alias("c"), T.narrative_mode(F.lit("short"), with_no_body=False).alias("d")).first()
    assert (r["a"], r["c"], r["d"]) == ("question_discussion", "story_personal", "opinion_argument")


def test_p_values(spark):
    """Against the exact values: a normal tail, chi-square of one degree of freedom, and t with 8 and 98."""
    r = spark.range(1).select(A.two_sided(F.lit(1.959963985)).alias("a"), A.two_sided(F.sqrt(F.lit(5.4))).alias("b"), A.correlation_p(F.lit(0.6), F.lit(10.0)).alias("c"), A.correlation_p(F.lit(0.25), F.lit(100.0)).alias("d"), A.correlation_p(F.lit(0.9), F.lit(2.0)).alias("e")).first()
    assert abs(r["a"] - 0.05) < 1e-6 and abs(r["b"] - 0.0201368) < 1e-6 and abs(r["c"] - 0.0667) < 5e-4 and abs(r["d"] - 0.01213) < 2e-4 and r["e"] == 1.0


def test_title_scores_and_tokens(spark):
    rows = [("Eight words that are just enough for this", 90), ("a b", 30), ("You won't believe this!!", 45), ("", 30)]
    df = spark.createDataFrame(rows, "t string, want long").withColumn("got", T.title_score(F.col("t"), F.lit(8), F.lit(22)))
    assert [tuple(r) for r in df.where("got <> want").collect()] == []
    r = spark.range(1).select(T.tokens(F.lit("Red fox, red hat")).alias("t"), T.request_words(F.lit("The best \u4f60\u597d tool and tool")).alias("w"), T.flair(F.lit("a setup walkthrough")).alias("f"), T.engaging(F.lit("It works. Thoughts")).alias("e")).first()
    assert r["t"] == ["fox", "foxred", "hat", "red", "redfox", "redhat"] and r["w"] == ["\u4f60\u597d", "best", "tool", "tool"] and r["f"] == "Guide" and r["e"]


def test_readability_of_empty(spark):
    r = spark.range(1).select(T.readability(F.lit("")).alias("a"), T.readability(F.lit("The cat sat. It ate.")).alias("b"), T.paragraphs(F.lit("a\n\nb\n\n\n\nc")).alias("p")).first()
    assert tuple(r["a"]) == (0.0, 0.0) and r["b"]["ease"] == 100.0 and r["b"]["grade"] == 0.0 and r["p"] == 4


def test_pattern_selection(spark):
    patterns = spark.createDataFrame([("p0", "t1", "story_opener", 0.5, None, 120), ("p1", "t1", "story_opener", 0.9, 0.1, 20), ("p2", "t2", "tutorial_howto", 0.2, None, 40)], "pattern_id string, tier string, hook string, rate double, live double, n long")
    requests = spark.createDataFrame([("r", "t1", ["guide"]), ("q", "t2", [])], "request_id string, tier string, words array<string>")
    out = {(r["request_id"], r["rank"]): (r["pattern_id"], r["score"]) for r in R.select_patterns(requests, patterns, 2).collect()}
    assert out == {("r", 1): ("p0", 75.0), ("r", 2): ("p2", 34.0), ("q", 1): ("p2", 56.0), ("q", 2): ("p0", 45.0)}
    assert [r["pattern_id"] for r in R.generic_patterns(patterns, 2).collect()] == ["p1", "p0"]


def test_threshold_choice(spark):
    rows = [(0.9, True), (0.8, True), (0.7, False), (0.2, False), (0.1, True)]
    swept = V.sweep(spark.createDataFrame(rows, "probability double, label boolean"), [0.15, 0.5, 0.75])
    got = {r["cutoff"]: (r["tp"], r["fp"], r["fn"]) for r in swept.collect()}
    assert got == {0.15: (2, 2, 1), 0.5: (2, 1, 1), 0.75: (2, 0, 1)}
    assert V.calibrated(swept, 0.6, 0.6).first()["cutoff"] == 0.75 and V.calibrated(swept, 0.9, 0.9).first()["pass"] == 2 and V.calibrated(swept.where("cutoff < 0.7"), 0.9, 0.9).first()["pass"] == 3


def test_boosted_model_and_guard(spark):
    posts = S.posts(spark, "/root/testdata/sf0.01")
    scored = V.boosted(posts, "2024-01-15", trees=3, depth=3)
    out = scored.agg(F.min("probability").alias("a"), F.max("probability").alias("b"), F.count("*").alias("n")).first()
    assert out["n"] > 100 and 0 <= out["a"] < out["b"] <= 1
    assert V.boosted(posts.limit(50), "2024-01-15").count() == 0


def test_streaks(spark):
    rows = [(i, "p", "2024-01-01", f) for i, f in enumerate(["failed", "viral", "failed", "failed"])] + [(10 + i, "q", "2024-01-01", "failed") for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, pattern_id string, tracked_at string, performance string")
    assert {(r["pattern_id"], r["streak"], r["status"]) for r in B.streaks(df).collect()} == {("p", 2, "active"), ("q", 12, "inactive")}


def test_latest_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "u", 5), (2, "u", 9), (3, None, 1), (4, None, 2)], "id long, url string, upvotes long")
    assert sorted(r["id"] for r in A.latest(df, "url", [F.desc("upvotes"), "id"]).collect()) == [2, 3, 4]


def test_distribution_of_one_value(spark):
    df = spark.createDataFrame([(7,)] * 3, "v long")
    assert [(r["bin"], r["n"]) for r in A.histogram(df, "v", 4).collect()] == [(2, 3)]


def test_milestones(spark):
    assert spark.range(1).select(T.milestones(F.lit(20), F.lit(120)).alias("m")).first()["m"] == [25, 50, 100]


def test_pattern_match_in_parts(spark):
    """Posts that fit only parts of a pattern, in another tier and media, are predicted from the threshold on."""
    schema = "tier string, hook string, narrative string, content_type string, template string, t_lo long, t_hi long, b_lo long, b_hi long"
    patterns = spark.createDataFrame([("t1", "list", "story", "text", "red fox|blue bird", 2, 6, 10, 20)], schema)
    posts = [
        ("t2", "list", "story", "video", "A Red Fox", 3, 0, True),  # 0.2 + 0.2 + 0.35 * 0.7 + 0.125
        ("t1", "list", "story", "text", "other", 1, 5, False),  # 0.4
        ("t3", "list", "list", "image", "other words", 2, 15, True),  # 0.2 + 0.25
        ("t1", "number", "list", "text", "red fox and blue bird", 5, 15, True),  # 0.35 + 0.25
        ("t1", "number", "list", "text", None, None, None, False),
    ]
    df = spark.createDataFrame(posts, "tier string, hook string, narrative string, content_type string, title string, title_words long, body_words long, want boolean")
    out = M.matched(df, patterns).collect()
    assert len(out) == 5 and all(r["predicted"] == r["want"] for r in out)
    assert not any(r["predicted"] for r in M.matched(df, patterns.limit(0)).collect())


def test_title_templates(spark):
    rows = [("a", t) for t in ("The Red fox, again!", "red FOX runs", "a red fox", "blue bird", "x")] + [("b", "red fox"), ("b", "red fox")]
    out = M.templates(spark.createDataFrame(rows, "k string, title string"), ["k"]).collect()
    assert [(r["k"], r["template"]) for r in out] == [("a", "red fox")]


def test_backtest_counts_every_dated_post(spark):
    out = registry.QUERIES["c3_backtest"](spark, SF).collect()
    assert out and all(r["tp"] + r["fp"] + r["fn"] + r["tn"] > 0 for r in out)


def test_answers_of_a_model(spark):
    raw = [('{"a": 1}', 1), ('see\n```json\n{"a": 2}\n```\nor {', 2), ('so {"a": 3} then', 3), ("none {", None), ("", None), (None, None)]
    df = spark.createDataFrame(raw, "raw string, want int")
    assert [r["x"] for r in df.select(F.get_json_object(D.json_text(F.col("raw")), "$.a").cast("int").alias("x")).collect()] == [w for _, w in raw]
    text = "Labels\n1: Story.\n 2) a-question!\n3. other\nno label\n4: "
    got = spark.range(1).select(D.numbered_labels(F.lit(text), ["story", "question"]).alias("x")).first()["x"]
    assert got == ["story", "question", "story"]


def test_draft_and_failure_reasons(spark):
    rows = [("one two", "", 0.9, None), ("a b c d e f", "w " * 30, 0.4, 10), ("a b c d e f", "w " * 30, 0.8, 50), (None, None, None, None)]
    df = spark.createDataFrame(rows, "title string, body string, ratio double, rate int")
    got = df.select(D.attribution(*[F.col(x) for x in ("title", "body", "ratio", "rate")]).alias("k")).select("k.*").collect()
    assert [r["primary"] for r in got] == ["title", "quality", None, "title"]
    assert got[1]["secondary"] == ["pattern"] and len(got[1]["actions"]) == 2 and got[2]["actions"] == ["take another pattern or community"]
    drafts = df.select(D.draft_check(F.col("title"), F.col("body"), F.lit("pain_point"), F.lit(5), F.lit(8), F.lit(20), F.lit(40)).alias("k")).select("k.*").collect()
    assert [r["passed"] for r in drafts] == [False, True, True, False]
    assert drafts[0]["suggestions"] == ["title length", "short title", "no body"] and drafts[1]["body_length"] == 100


def test_a_model_needs_enough_rows(spark):
    from tractionlens.operators import validation as V
    from tractionlens.sources import posts as S

    few = S.posts(spark, "/root/testdata/sf0.001").limit(20)
    assert V.importances(few, "2024-01-15").count() == 0 and V.boosted(few, "2024-01-15").count() == 0


def test_valence(spark):
    posts = spark.createDataFrame([("a", "good good day"), ("b", "nothing"), ("c", None), ("d", "bad Good")], "post_id string, title string")
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "word string, valence double")
    got = {r["post_id"]: round(r["compound"], 6) for r in V.valence_scores(posts, lexicon).collect()}
    assert got == {"a": round(4 / 31**0.5, 6), "b": 0, "c": 0, "d": 0}
    assert set(V.valence_scores(posts, lexicon.limit(0)).select("compound").distinct().collect()) == {(0.0,)}


def test_spearman_of_many_rows(spark):
    """n times the sum of squared ranks passes 64 bits: 60,000 rows in exact order have r = 1, and large scores don't overflow either."""
    df = spark.range(60_000).select(F.lit("a").alias("k"), "id", (F.col("id") * 3_000_000).alias("x"), (-F.col("id") * 7).alias("y"))
    (up,), (down,) = (A.spearman(df.withColumn("z", F.col(z)), "id", "z", ["k"]).select("r", "n").toPandas().itertuples(index=False) for z in ("x", "y"))
    assert abs(up.r - 1) < 1e-12 and abs(down.r + 1) < 1e-12 and up.n == 60_000
    assert abs(A.pearson(df, "x", "id", []).first()["r"] - 1) < 1e-12


@pytest.mark.parametrize("cut", [0, 1])
def test_whole_jobs_of_communities_and_narratives(spark, tmp_path, cut):
    """f1 returns every post of the community, and a24 every post, those with short bodies too."""
    docs = [(i, f"Title number {i}. " + ("" if i % 5 == 0 else "words of a longer body " * 3), "en", "src3", 10) for i in range(90)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, 7, "click", float(i), '{"k": 1}') for i in range(90)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    if cut:
        got = registry.QUERIES["a24_narrative_stats"](spark, str(tmp_path)).collect()
        assert sum(r["n"] for r in got) == 90 and {r["narrative"]: r["n"] for r in got}["no_body"] == 18
    else:
        got = registry.QUERIES["f1_posts_of_community"](spark, str(tmp_path)).collect()
        assert len(got) == 90 and [r["upvotes"] for r in got] == sorted((r["upvotes"] for r in got), reverse=True)


def test_syllables_and_sentences_of_whole_texts(spark):
    """Counts over a whole text equal those word by word, and readability has no step per word."""
    texts = ["", " ", "The cat sat. It ate.", "e e. e.e .e. !e? eye, be... queue; rhythm myth ée", "Be... a!? ?! ;:.\n\tsee\x0bthe  tree.e", "hmm. 42! \n. x", "whale-like agree,e e,", "  . ! ? ", "ÉTUDE apple.Apple apple.", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    words = F.transform(F.regexp_extract_all(F.lower("t"), F.lit(r"([^\s]+)"), F.lit(1)), lambda w: F.btrim(w, F.lit(".:;?!")))
    by_word = F.aggregate(words, F.lit(0), lambda a, w: a + T.syllables(w))
    parts = F.size(F.filter(F.split("t", r"[.!?]+"), lambda s: F.trim(s) != ""))
    rows = df.where("t IS NOT NULL").select("t", T.text_syllables(F.lower("t")).alias("a"), by_word.alias("b"), T.n_sentences(F.col("t")).alias("c"), parts.alias("d")).collect()
    assert [(r["t"], r["a"], r["c"]) for r in rows] == [(r["t"], r["b"], r["d"]) for r in rows]
    plan = df.select(T.readability(F.col("t"))["ease"])._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan


def test_draft_checks_read_a_body_once(spark):
    df = spark.createDataFrame([("t", "b", "pain_point")], "t string, b string, h string")
    plan = df.select(D.draft_check(F.col("t"), F.col("b"), F.col("h"), F.lit(5), F.lit(8), F.lit(20), F.lit(40)).alias("k")).select("k.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[aeiouy]+, 0") <= 1, plan
    plan = df.select(D.attribution(F.col("t"), F.col("b"), F.lit(0.5), F.lit(10)).alias("k")).select("k.primary", "k.confidence")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2, plan


def test_patterns_scan_the_texts_once(spark):
    """What mining reads of the posts is written once; holdout and details then read that table."""
    posts = S.posts(spark, SF)
    for plan in (V.holdout(posts, percentile=0.8), registry.QUERIES["a43_pattern_details"](spark, SF)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "documents" not in text and "regexp_extract(text" not in text
