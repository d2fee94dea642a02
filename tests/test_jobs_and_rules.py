"""Literal cases of the rules, and of collection, classification, intervals and the analysis of all levels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractionlens.functions import special as Z
from tractionlens.functions import text as T
from tractionlens.operators import analysis as A
from tractionlens.operators import classification as K
from tractionlens.operators import collection as C
from tractionlens.operators import fanout as N
from tractionlens.operators import feedback as B
from tractionlens.operators import mining as M
from tractionlens.operators import resampling as P
from tractionlens.operators import selection as R
from tractionlens.operators import validation as V
from tractionlens.sources import posts as S

SF = "/root/testdata/sf0.001"
POST = "post_id string, doc_id long, subreddit string, title string, body string, tier string, content_type string, created_utc timestamp, upvotes long, num_comments long, upvote_ratio double, flair string"


def _posts(spark, *rows):
    """Posts of given fields; the rest is plain."""
    plain = {"subreddit": "s", "title": "a plain title of six words", "body": "", "tier": "t1", "content_type": "text", "created_utc": None, "upvotes": 1, "num_comments": 0, "upvote_ratio": 1.0, "flair": None}
    made = [{**plain, "post_id": f"p{i}", "doc_id": i, **r} for i, r in enumerate(rows)]
    names = [x.split()[0] for x in POST.split(", ")]
    return spark.createDataFrame([tuple(m[n] for n in names) for m in made], POST.replace("timestamp", "string")).withColumn("created_utc", F.col("created_utc").cast("timestamp"))


# ---------------------------------------------------------------- rules


def test_inflections_name_the_bin_before(spark):
    counts = (0, 1, 4, 9, 10, 9, 4, 1, 0, 3)
    hist = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "bin long, n long")
    assert sorted(r["bin"] for r in A.inflections(hist, 10).collect()) == [3, 6]


def test_title_flags_and_templates(spark):
    titles = ["A: b", "a - b", "a-b", "a — b", "see (this)", "see [this]", "Why? ", "Why?", "3 cats", ""]
    df = _posts(spark, *[{"title": t} for t in titles])
    rates = A.rates(df.where("title <> ''"), A.title_flags(), []).first()
    assert rates["n"] == 9 and [round(rates[k] * 9) for k in ("colon", "dash", "parenthesis", "number", "question")] == [1, 2, 1, 1, 2]
    many = _posts(spark, *[{"title": "Is it: 3 (or) - 4?"}] * 5, *[{"title": "plain"}] * 7, *[{"title": "why? "}] * 4)
    assert [(r["template"], r["n"]) for r in A.templates(many).collect()] == [("||||", 11), ("colon|dash|question|number|bracket", 5)]


def test_body_flags_and_calls(spark):
    bodies = ["- one of many items", "1. first of the items", "see TL;DR at the end", "see tldr at the end ..", "TLDRX is not a summary", "some **bold** words here", "> quoted words of others", "text\n> quoted further down", "what is it that you do? \n", "please Share your own views"]
    df = _posts(spark, *[{"body": b} for b in bodies])
    got = A.rates(df, A.body_flags(), []).first()
    assert [round(got[k] * 10) for k in ("list", "tldr", "bold", "quote", "ending_question", "call_to_action")] == [1, 2, 1, 2, 1, 1]
    assert [r["x"] for r in df.orderBy("doc_id").select(T.calls_to_answer(F.col("body")).alias("x")).collect()] == [False] * 8 + [True] * 2


def test_growth_classes(spark):
    day = "2024-05-31 00:00:00"
    rows = [(5000, 0, day), (200, 400, day), (600, 400, day), (50, 10, day), (50, 1, day), (0, 5, day), (10, 5, None)]
    got = {r["growth"]: (r["n"], round(r["share"], 4)) for r in A.growth_classes(_posts(spark, *[{"upvotes": u, "num_comments": k, "created_utc": t} for u, k, t in rows]), "2024-06-01 00:00:00").collect()}
    assert got == {"exponential": (1, 0.1429), "impulsive": (1, 0.1429), "bimodal": (1, 0.1429), "linear": (1, 0.1429), "logarithmic": (1, 0.1429), "unknown": (2, 0.2857)}


def test_anti_patterns(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(words(4), "b"), (words(31), "b"), (words(5), ""), (words(30), words(1001)), (words(30), words(1000))]
    df = M.features(_posts(spark, *[{"title": t, "body": b, "upvotes": i % 3} for t, b in rows for i in range(10)], *[{"upvotes": 100}] * 9))
    got = {r["bucket"]: (r["n"], r["failure_rate"], r["exemplars"]) for r in M.anti_patterns(df, 0.9).collect()}
    assert {k: v[0] for k, v in got.items()} == dict.fromkeys(("very_short_title", "very_long_title", "no_body_text", "very_long_body", "generic_low_engagement"), 10)
    assert got["very_long_title"][2] == ["p10", "p11", "p12"] and got["no_body_text"][1] == 0.4
    assert M.anti_patterns(df.limit(5), 0.9).count() == 0


def test_specificity_takes_words_of_titles_and_bodies(spark):
    a = [{"subreddit": "a", "title": "w " * 4, "body": "b " * 10}] * 20
    b = [{"subreddit": "b", "title": "w " * 8, "body": "b " * 30, "upvotes": 999}] * 20
    few = [{"subreddit": "c", "title": "w", "body": "b"}] * 3
    got = {r["subreddit"]: r["score"] for r in A.specificity(_posts(spark, *a, *b, *few)).collect()}
    assert set(got) == {"a", "b"} and got["b"] == 1.0 and got["a"] == 0.0


def test_dashboard_and_best_times(spark):
    rows = [(1, 7, "s", 100 + i, f"2024-01-02 0{i}:00:00", "viral") for i in range(5)] + [(9, 7, "s", 0, "2024-01-03 00:00:00", "failed"), (10, 8, "r/webdev", 3, "2024-01-01 00:00:00", "failed"), (11, 7, "t", 500, "2024-01-05 00:00:00", "failed")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, subreddit string, actual_upvotes long, tracked_at string, performance string").withColumn("tracked_at", F.col("tracked_at").cast("timestamp"))
    seven = B.dashboard(df).where("user_id = 7").first()
    assert (seven["n"], seven["total"], seven["best_subreddit"], seven["milestones"]) == (6, 1010, "t", 5) and seven["recent"].split()[0] == "t:500:failed" and len(seven["recent"].split()) == 5
    times = [tuple(r) for r in B.best_times(df).orderBy("user_id", "subreddit", "rank").collect()]
    assert [t for t in times if t[:2] == (7, "s")] == [(7, "s", "Tuesday", "14:00-17:00 UTC", 90, 1), (7, "s", "Wednesday", "13:00-16:00 UTC", 68, 2), (7, "s", "Thursday", "15:00-18:00 UTC", 65, 3)]
    assert [t[2:5] for t in times if t[0] == 8] == [("Monday", "14:00-17:00 UTC", 80), ("Thursday", "13:00-16:00 UTC", 78), ("Saturday", "10:00-14:00 UTC", 65)]
    assert [t[4] for t in times if t[:2] == (7, "t")] == [70, 68, 65]


# ---------------------------------------------------------------- collection


def test_merge_and_two_deduplications(spark):
    schema = "post_id string, subreddit string, upvotes long, url string, source_dataset string"
    first = spark.createDataFrame([("a", "S1", 5, "u1", "dump"), ("b", "S1", 5, None, "dump"), (None, "S1", 1, None, "dump")], schema)
    second = spark.createDataFrame([("a", "S1", 99, "u1", "api"), ("c", "s2", 9, "u1", "api"), ("d", "s2", 9, "u1", "api"), ("e", "s3", 1, "", "api"), ("e", "s3", 4, "", "api"), (None, "s3", 2, None, "api"), ("f", "s3", 1, "", "api")], schema)
    tiers = spark.createDataFrame([("s1", "t1"), ("S2", "t2"), ("s9", "t3")], "subreddit string, tier string")
    posts, links, report = C.collected([first, second], tiers, 3)
    got = {(r["post_id"], r["upvotes"], r["tier"]) for r in posts.collect()}
    assert got == {("c", 9, "t2"), ("b", 5, "t1"), (None, 1, "t1"), (None, 2, None), ("e", 4, None), ("f", 1, None)}
    assert sorted(tuple(r) for r in links.collect()) == [("a", "S1", "c"), ("d", "s2", "c")]
    said = {(r["dimension"], r["value"]): r["n"] for r in report.collect()}
    assert said["step", "merged"] == 9 and said["step", "single"] == 8 and said["step", "crossposts"] == 2
    assert (said["tier", "unknown"], said["shortfall", "s9"], said["shortfall", "s2"], said["source_dataset", "api"]) == (3, 3, 2, 4)
    assert C.by_url(first.limit(0).withColumn("seq", F.lit(1))).count() == 0


# ---------------------------------------------------------------- classification


def _model(log, fail=False):
    """Answers every prompt and notes it in a file; `long` for titles of over ten characters, nothing for those with an x."""

    def ask(prompt: str) -> str:
        with open(log, "a", encoding="utf-8") as f:
            f.write("call\n" + "".join(line + "\n" for line in prompt.splitlines() if line[:1].isdigit()))
        if fail:
            raise RuntimeError("no model")
        lines = [line.split(". ", 1) for line in prompt.splitlines() if line[:1].isdigit()]
        return "Here:\n" + "\n".join(f"{i}) {'LONG_title.' if len(t) > 12 else 'short'}" for i, t in reversed(lines) if "x" not in t)

    return ask


def test_classification_asks_once(spark, tmp_path):
    log, cache = tmp_path / "log", str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "a short"), (2, "a long long long title"), (3, "a short"), (4, None), (5, "x marks"), (6, 'say "hi"\nto all of them')], "id long, title string").repartition(3)
    about = {"long_title": "many words", "short": "few words"}
    rule = lambda t: F.lit("by rule")
    run = lambda **more: {r["id"]: (r["label"], r["origin"]) for r in K.classified_texts(df, "title", _model(log, more.pop("fail", False)), about, cache, rule, **more).collect()}
    want = {1: ("short", "model"), 2: ("long_title", "model"), 3: ("short", "model"), 4: (None, "none"), 5: ("by rule", "rule"), 6: ("long_title", "model")}
    assert run() == want
    lines = log.read_text().splitlines()
    assert sum("a short" in x for x in lines) == 1 and sum(x != "call" for x in lines) == 4
    before = len(lines)
    assert run() == want and len(log.read_text().splitlines()) == before
    assert run(again=True) == want and [x[3:] for x in log.read_text().splitlines()[before + 1 :]] == ['"x marks"']
    assert run(task="body", fail=True) == {k: v if k == 4 else ("by rule", "rule") for k, v in want.items()}
    assert run(task="body", again=True) == want


def test_numbered_answers(spark):
    said = lambda text, i: spark.createDataFrame([(text,)], "r string").select(K.numbered_answers(F.col("r"), F.lit(i), ["story_opener", "pain_point", "story"]).alias("x")).first()["x"]
    text = "1: pain_point\n 3. Story_Opener!\n4: pain\n5: nothing of these\n3: story"
    assert [said(text, i) for i in (1, 2, 3, 4, 5)] == ["pain_point", None, "story_opener", "pain_point", None]
    assert said(None, 1) is None and said("1: story", 1) == "story"


# ---------------------------------------------------------------- intervals and tails


def test_tails_against_closed_forms(spark):
    for t in (0.01, 0.5, 1.0, 3.0, 40.0):
        assert abs(Z.t_tails(t, 1) - (1 - 2 / math.pi * math.atan(t))) < 1e-12
        assert abs(Z.t_tails(t, 2) - (1 - t / math.sqrt(2 + t * t))) < 1e-12
        assert abs(Z.t_tails(t, 1e9) - math.erfc(t / math.sqrt(2))) < 1e-8
        assert abs(Z.t_tails(t, 999_999) - Z.t_tails(t, 1_000_001)) < 1e-9
    for x in (0.1, 2.0, 30.0):
        assert abs(Z.chi_square_tail(x, 4) - math.exp(-x / 2) * (1 + x / 2)) < 1e-13
        assert abs(Z.gamma_tail(0.5, x / 2) - math.erfc(math.sqrt(x / 2))) < 1e-13
    assert Z.correlation_tails(0.5, 9) == 1.0 and Z.correlation_tails(1.0, 20) == 0.0 and Z.chi_square_tail(0, 3) == 1.0
    df = spark.createDataFrame([(0.5, 20), (None, 20), (0.0, 50)], "r double, n long")
    got = [r["p"] for r in df.select(Z.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    x = np.linspace(0, 0.5 * math.sqrt(18 / 0.75), 20_001)  # Simpson's rule for the density with 18 degrees of freedom
    density = math.exp(math.lgamma(9.5) - math.lgamma(9)) / math.sqrt(18 * math.pi) * (1 + x * x / 18) ** -9.5
    inside = (density[0] + density[-1] + 4 * density[1::2].sum() + 2 * density[2:-1:2].sum()) * (x[1] - x[0]) / 3
    assert abs(got[0] - (1 - 2 * inside)) < 1e-11 and got[1] is None and got[2] == 1.0


@pytest.mark.parametrize("n, p", [(1, 0.5), (7, 0.1), (40, 0.33), (100, 0.999)])
def test_binomial_quantiles(n, p):
    upto, want = 0.0, {}
    for k in range(n + 1):
        upto += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        for q in (0.025, 0.5, 0.975):
            if upto >= q - 1e-12:
                want.setdefault(q, k)
    assert {q: Z.binomial_quantile(q, n, p) for q in want} == want
    assert abs(Z.binomial_quantile(0.5, 10**10, 0.3) / 10**10 - 0.3) < 1e-5


def test_weights_of_counted_values():
    u = np.array([0.0, 0.3, 0.9999, 0.36787])
    assert P.poisson_quantiles(u, 1).tolist() == [0, 0, 6, 0]
    mean = P.poisson_quantiles((np.arange(2000) + 0.5) / 2000, 10_000).mean()
    assert abs(mean - 10_000) < 1
    assert P.median_of(np.array([1, 2, 5]), np.array([1, 1, 2])) == 3.5 and P.median_of(np.array([1, 2, 5]), np.array([3, 1, 1])) == 1.0
    assert P.mean_of(np.array([1, 4]), np.array([1, 2])) == 3.0


def test_bootstrap_of_a_hot_value_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 3)] * 50 + [("b", None)], "g string, v long")
    rows = P.bootstrap(df, "v", "g", draws=30, block=7).collect()
    assert [(r["g"], r["n"], r["lower"], r["upper"]) for r in rows] == [("a", 50, 3.0, 3.0)]


# ---------------------------------------------------------------- all levels at once


def test_analysis_equals_single_queries(spark):
    posts = S.posts(spark, SF)
    got = {(r["level"], r["key"], r["part"], r["measure"], r["value"], r["statistic"]): r["amount"] for r in N.analyzed(posts).collect()}
    for r in A.rates(posts.where("title <> ''"), A.title_flags(), ["tier"]).collect():
        assert got["tier", r["tier"], "title", "number", None, "rate"] == r["number"]
    for r in A.class_stats(posts.where("title <> ''"), T.hook_type(F.col("title")), "hook", ["tier"]).collect():
        key = ("tier", r["tier"], "title", "hook", r["hook"])
        assert all(abs(got[(*key, k)] - r[k]) < 1e-9 for k in ("share", "avg_upvotes", "std"))
    for r in A.distribution(posts.where(F.length("body") >= 20).withColumn("w", T.n_words(F.col("body"))), "w", ["subreddit"]).collect():
        key = ("subreddit", r["subreddit"], "body", "word_count", None)
        assert all(abs(got[(*key, k)] - r[k]) < 1e-9 for k in ("n", "mean", "std", "p10", "p50", "p95", "p99"))
    gain = A.gain(posts.where("title <> ''"), T.has_any(F.lower("title"), T.TIME_WORDS)).first()
    assert abs(got["all", "all", "title", "temporal", None, "gain"] - gain["gain"]) < 1e-9


def test_analysis_reads_posts_once_and_takes_odd_rows(spark):
    cube = N.measure_cube(S.posts(spark, SF))
    plan = cube._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") <= 3  # the posts' own three reads: texts, counts for the events, nothing else
    odd = _posts(spark, {"title": "", "tier": None}, {"title": "Ä ß: why?", "body": None, "subreddit": "S", "created_utc": "2024-01-01 05:00:00", "flair": ""}, {"title": None})
    rows = {(r["level"], r["key"], r["measure"], r["value"], r["statistic"]): r["amount"] for r in N.analyzed(odd).collect()}
    assert rows["all", "all", "word_count", None, "n"] == 1 and rows["subreddit", "s", "flaired", None, "rate"] == 0.0
    assert rows["all", "all", "hour", "05", "n"] == 1 and ("tier", None, "flaired", None, "n") not in rows
    assert N.analyzed(odd.limit(0)).count() == 0


# ---------------------------------------------------------------- patterns and requests


def test_patterns_need_enough_posts(spark):
    rows = [{"title": "cats vs dogs today", "upvotes": 100}] * 9 + [{"title": "plain words", "upvotes": i % 5} for i in range(18)]
    assert M.over_represented(M.features(_posts(spark, *rows)), 0.6, least=10).count() == 0
    more = M.features(_posts(spark, *rows, *rows))
    found = M.over_represented(more, 0.7, least=10, least_viral=5, critical=0.0)
    best = M.detailed(more, found, 0.7).first()
    assert best["exemplars"] == ["p0", "p1", "p2", "p3", "p4"] and best["communities"] == ["s"] and (best["t_lo"], best["t_hi"]) == (4, 4)


def test_patterns_are_chosen_within_a_row(spark):
    patterns = spark.createDataFrame([("p1", "t1", "pain_point", 0.5, None, 200), ("p0", "t1", "pain_point", 0.5, None, 200), ("p2", "t2", "story_opener", 0.9, 0.1, 40), ("p3", "t2", "number_shock", 0.0, None, 1)], "pattern_id string, tier string, hook string, rate double, live double, n long")
    requests = spark.createDataFrame([("r", "t1", ["hard", "story"]), ("q", None, [])], "request_id string, tier string, words array<string>")
    got = sorted((r["request_id"], r["rank"], r["pattern_id"], round(r["score"], 6)) for r in R.select_patterns(requests, patterns, 2).collect())
    # t1: 40 + 20 + 15 + 8 for p0 before the equal p1 of the same hook, then 10 + 26.4 + 8 + 15 for p2; without a tier 10 for all
    assert got == [("q", 1, "p0", 45.0), ("q", 2, "p2", 44.4), ("r", 1, "p0", 83.0), ("r", 2, "p2", 59.4)]


def test_recommendation_falls_back(spark):
    index = spark.createDataFrame([("alpha", "garden", 9, 1)], "subreddit string, word string, n long, rank int")
    hints = spark.createDataFrame([("tomato", "webdev")], "word string, subreddit string")
    patterns = spark.createDataFrame([("p1", "t1", "pain_point", 0.5, None, 200)], "pattern_id string, tier string, hook string, rate double, live double, n long")
    tiers = spark.createDataFrame([("alpha", "t1"), ("webdev", "t2")], "subreddit string, tier string")
    requests = spark.createDataFrame([("a", "my garden guide"), ("b", "tomato garden"), ("c", "")], "request_id string, text string")
    got = {r["request_id"]: r for r in R.recommended(requests, index, hints, patterns, tiers, "other").collect()}
    assert (got["a"]["communities"], got["a"]["tier"], got["a"]["flair"]) == (["alpha"], "t1", "Resource")
    assert (got["b"]["communities"], got["b"]["day"], got["b"]["window"]) == (["webdev", "alpha"], "Monday", "14:00-17:00 UTC")
    assert (got["c"]["communities"], got["c"]["tier"], [p["pattern_id"] for p in got["c"]["patterns"]]) == (["other"], None, ["p1"])


def test_gate_of_tiers(spark):
    rows = []
    for tier in ("t1", "t2"):
        for i in range(120):
            good = i % 3 == 0
            rows.append({"tier": tier, "subreddit": f"{tier}s{i // 3 % 6}", "title": "cats vs dogs in every house" if good else "plain words of no note", "body": "long body words " * 5, "upvotes": 100 + i if good else i % 7, "created_utc": f"2024-01-{1 + i % 28:02d} 00:00:00"})
    rows += [{"tier": "t3", "created_utc": "2024-01-01 00:00:00"}] * 5
    got = {r["tier"]: r for r in V.stratified(_posts(spark, *rows), "2024-01-15", n=2, percentile=0.7, least_posts=20).collect()}
    assert set(got) == {"t1", "t2"}
    assert all(r["backtest_passed"] and r["holdout_passed"] and r["passed"] and r["recall"] == 1.0 for r in got.values())
    matrix = V.transfer_matrix(_posts(spark, *rows), 0.7).collect()
    assert {(r["source_tier"], r["target_tier"]) for r in matrix} == {(a, b) for a in V.TIERS for b in V.TIERS if a != b}


def test_snapshots_of_a_post_are_reduced_before_the_sort(spark):
    """Rows that differ in their score only meet in a hash aggregate; ties, nulls and rows without an id stay as they were."""
    rows = [("a", "s", u, 1) for u in (3, 9, 5)] + [("a", "t", 9, 0), ("b", "s", None, 2), ("b", "s", None, 2), (None, "s", 4, 3), (None, "s", 4, 3), ("", "s", 1, 4)]
    df = spark.createDataFrame(rows, "post_id string, subreddit string, upvotes long, seq long")
    out = C.by_id(df)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([("a", "t", 9, 0), ("b", "s", None, 2), (None, "s", 4, 3), (None, "s", 4, 3), ("", "s", 1, 4)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "functions=[max(upvotes" in plan or "functions=[partial_max(upvotes" in plan
