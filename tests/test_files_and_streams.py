"""Readers, writers and streams over small files."""

import gzip
import json
import os
import random

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tractionlens.operators import evolution as E
from tractionlens.sources import files as S
from tractionlens.sources import patterns as D
from tractionlens.sources.files import export, read_json_documents
from tractionlens.streaming import feedback as X


def test_delimited_and_normalized(spark, tmp_path):
    text = 'Submission_ID;Sub;post_title;selftext;score;created;over_18;url\na1;r/x;"Hi; you";"two\nlines";5;1700000000;1;http://h/a.gif\nt3_b;;;;abc;;;\nc;y;T;;;2024-01-02 03:04:05;0;https://v.redd.it/q\n'
    with gzip.open(tmp_path / "p.csv.gz", "wt") as f:
        f.write(text)
    df = S.normalized(S.read_delimited(spark, str(tmp_path / "p.csv.gz")))
    rows = {r["post_id"]: r for r in df.collect()}
    assert set(rows) == {"t3_a1", "t3_c"}  # the score abc can't be read
    a, c = rows["t3_a1"], rows["t3_c"]
    assert (a["subreddit"], a["title"], a["body"], a["upvotes"], a["is_nsfw"], a["content_type"], a["author"]) == ("x", "Hi; you", "two\nlines", 5, True, "video", "[deleted]")
    assert a["created_utc"].timestamp() == 1700000000 and c["content_type"] == "video" and c["upvotes"] == 0 and c["created_utc"] is not None
    lenient = S.normalized(S.read_delimited(spark, str(tmp_path / "p.csv.gz")), strict=False)
    assert {r["post_id"]: r["upvotes"] for r in lenient.collect()} == {"t3_a1": 5, "t3_b": 0, "t3_c": 0}


def test_media_rules(spark):
    cases = [("dump", "http://a.png", False, False, "", "image"), ("dump", "http://a.png", True, False, "", "text"), ("dump", "", True, True, "", "video"), ("archive", "", True, False, "image", "image"), ("archive", "http://q", False, False, "", "link"), ("archive", "http://v.redd.it/1", True, False, "", "video"), ("table", "http://q", True, False, "", "link")]
    for rules, url, own, video, hint, want in cases:
        got = spark.range(1).select(S.media_type(F.lit(url), rules, F.lit(own), F.lit(video), F.lit(hint)).alias("m")).first()["m"]
        assert got == want, (rules, url)


def test_crossrefs(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("# note\na\tt3_1\nalone\nb\tt3_2\textra\n")
    assert sorted(map(tuple, S.read_crossrefs(spark, str(tmp_path / "x.tsv")).collect())) == [("a", "t3_1"), ("b", "t3_2")]


def test_jsonl_round_trip_and_quarantine(spark, tmp_path):
    schema = StructType([StructField("id", LongType()), StructField("t", StringType())])
    df = spark.createDataFrame([(1, "a"), (2, None)], schema)
    S.write_jsonl(df, str(tmp_path / "j"), compress=True)
    S.write_jsonl(df, str(tmp_path / "j"), append=True, compress=True)
    good, bad = S.read_jsonl(spark, str(tmp_path / "j"), schema)
    assert good.count() == 4 and bad.count() == 0
    (tmp_path / "k.jsonl").write_text('{"id": 1}\n\nnot json\n{"id": "x"}\n')
    good, bad = S.read_jsonl(spark, str(tmp_path / "k.jsonl"), schema)
    assert [tuple(r) for r in good.collect()] == [(1, None)] and bad.count() == 2


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, seq long")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, seq long")
    assert sorted((r["k"], r["v"]) for r in S.upsert(old, new, ["k"], "seq").collect()) == [(1, "a"), (2, "d"), (3, "e")]


def _events(path, name, rows):
    keys = ("event_id", "post_id", "pattern_id", "subreddit", "tracked_at", "actual_upvotes")
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(json.dumps(dict(zip(keys, r))) + "\n" for r in rows))


def test_stream_classes_and_milestones(spark, tmp_path):
    at = "2024-01-01T00:00:00Z"
    _events(tmp_path / "in", "1.json", [(1, "p", "a", "s", at, 30), (1, "p", "a", "s", at, 30), (2, "q", "a", "s", at, 10)])
    medians = spark.createDataFrame([("s", 10.0)], "subreddit string, median double")
    rows = {}

    def run(frame, name):
        frame.writeStream.foreachBatch(lambda b, i: rows.setdefault(name, []).extend(b.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()

    run(X.classified(X.feedback_stream(spark, str(tmp_path / "in")), medians), "classes")
    assert sorted((r["event_id"], r["performance"]) for r in rows["classes"]) == [(1, "viral"), (2, "failed")]
    run(X.milestones(X.feedback_stream(spark, str(tmp_path / "in"))), "marks")
    _events(tmp_path / "in", "2.json", [(3, "p", "a", "s", at, 60)])
    run(X.milestones(X.feedback_stream(spark, str(tmp_path / "in"))), "marks")
    assert sorted((r["post_id"], r["milestone"]) for r in rows["marks"]) == [("p", 25), ("p", 50)]


def _rows(spark, *rows):
    """Feedback of one pattern a row: (event, pattern, day, performance)."""
    return spark.createDataFrame([(e, p, f"2024-01-{d:02d} 00:00:00", x) for e, p, d, x in rows], "event_id long, pattern_id string, t string, performance string").select("event_id", "pattern_id", F.col("t").cast("timestamp").alias("tracked_at"), "performance")


def _table(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("pattern_id", "n", "success_rate", "streak", "status").collect())


def test_evolve_gate_and_replays(spark, tmp_path):
    out = str(tmp_path / "o")
    run = X.evolve(out, gate=50, inactive_from=5)
    first = _rows(spark, *[(i, "a", 1 + i % 9, "viral" if i < 20 else "failed") for i in range(30)])
    run(first, 0)
    assert not (tmp_path / "o/rates/batch=0").exists()
    second = _rows(spark, *[(100 + i, "a", 11 + i % 3, "failed") for i in range(20)], *[(200 + i, "b", 11, "viral") for i in range(3)])
    run(second, 1)
    # the last success is on day 9 (event 17), one failure follows it there (event 26)
    rates = _table(spark, f"{out}/rates/batch=1")
    assert rates == [("a", 50, 0.4, 21, "inactive"), ("b", 3, 1.0, 0, "active")]
    log = sorted((r["pattern_id"], r["kind"], r["old_rate"], r["new_rate"]) for r in spark.read.parquet(f"{out}/log/batch=1").collect())
    assert log == [("a", "inactive", 0.0, 0.4), ("a", "up", 0.0, 0.4), ("b", "up", 0.0, 1.0)]
    run(second, 1)
    assert _table(spark, f"{out}/rates/batch=1") == rates
    assert len(log) == spark.read.parquet(f"{out}/log/batch=1").count()
    # a success ends the streak, but a pattern that went inactive stays so
    run(_rows(spark, (300, "a", 20, "passing"), (301, "b", 20, "failed"), (302, "c", 20, "failed")), 2)
    assert _table(spark, f"{out}/rates/batch=2") == [("a", 51, 0.4118, 0, "inactive"), ("b", 4, 0.75, 1, "active"), ("c", 1, 0.0, 1, "active")]
    assert [r["kind"] for r in spark.read.parquet(f"{out}/log/batch=2").collect()] == ["down"]


def test_evolved_state_equals_all_feedback_at_once(spark, tmp_path):
    """Batches in order, and batches with rows that come late."""
    r = random.Random(3)
    rows = [(i, f"p{r.randrange(4)}", r.randint(1, 28), r.choice(["failed", "failed", "viral", "passing"])) for i in range(120)]
    for name, batches in (("ordered", sorted(rows, key=lambda x: (x[2], x[0]))), ("late", rows)):
        out = str(tmp_path / name)
        run = X.evolve(out, gate=1)
        for k in range(4):
            run(_rows(spark, *batches[30 * k : 30 * k + 30]), k)
        state = sorted(tuple(x) for x in spark.read.parquet(f"{out}/state/batch=3").select("pattern_id", "n", "ok", "streak").collect())
        want = sorted(tuple(x) for x in E.folded(_rows(spark, *rows)).select("pattern_id", "n", "ok", "streak").collect())
        assert state == want


def test_evolution_keeps_unused_patterns_and_attributes_failures(spark):
    patterns = spark.createDataFrame([("a", 0.9, "active"), ("z", 0.3, "inactive")], "pattern_id string, success_rate double, status string")
    feedback = _rows(spark, *[(i, "a", 1 + i, "failed") for i in range(10)])
    table, log = E.evolved(patterns, feedback, gate=10)
    assert sorted(map(tuple, table.collect())) == [("a", 10, 0.0, 10, "inactive"), ("z", 0, 0.3, 0, "inactive")]
    assert sorted(r["kind"] for r in log.collect()) == ["down", "inactive"]
    table, log = E.evolved(patterns, feedback, gate=11)
    assert table.count() == 0 and log.count() == 0
    posts = feedback.limit(2).withColumns({"title": F.lit("one two"), "body": F.lit(None).cast("string"), "upvote_ratio": F.lit(0.8), "given": F.when(F.col("event_id") == 0, "known")})
    found = E.attributed(posts, patterns, F.col("given")).collect()
    assert [r["attribution"]["primary"] for r in found] == ["title"]


def test_daily_counts_of_a_stream(spark, tmp_path):
    days = [("a", "2024-01-01T01:00:00"), ("a", "2024-01-01T02:00:00"), ("b", "2024-01-02T01:00:00")]
    _events(tmp_path / "in", "1.json", [(i, "p", p, "s", t, 1) for i, (p, t) in enumerate(days)])
    stream = X.feedback_stream(spark, str(tmp_path / "in")).withColumn("performance", F.lit("failed"))
    query = X.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((str(r["day"])[:10], r["pattern_id"], r["n"]) for r in spark.table("daily").collect())
    assert got == [("2024-01-01", "a", 2), ("2024-01-02", "b", 1)]


def test_json_documents_newest_first_and_export(spark, tmp_path):
    for i, text in enumerate(('{"a": 1}', "{broken", '{"a": 3}')):
        f = tmp_path / f"d{i}.json"
        f.write_text(text)
        os.utime(f, (1_700_000_000 + 100 * i,) * 2)
    found = read_json_documents(spark, f"{tmp_path}/*.json", StructType([StructField("a", LongType())])).select("a").collect()
    assert [r["a"] for r in found if r["a"] is not None] == [3, 1]
    posts = spark.createDataFrame([("p1", "t1"), ("p2", "t2")], "post_id string, tier string")
    export(posts, posts.select("post_id"), posts.select("tier"), str(tmp_path / "out"))
    assert sorted(r["post_id"] for r in spark.read.parquet(f"{tmp_path}/out/posts/tier=t2").collect()) == ["p2"]
    assert spark.read.parquet(f"{tmp_path}/out/comments").count() == 2 and spark.read.parquet(f"{tmp_path}/out/crossrefs").columns == ["tier"]


def test_pattern_documents_round_trip_and_drift(spark, tmp_path):
    full = {"pattern_id": "p1", "applicable_subreddits": ["a", "b"], "confidence_interval": [0.0, 0.25], "recommended_metrics": {"title_words": [8, 11]}, "tier_effectiveness": {"t2": 0.5}, "sample_size": 15, "more": {"x": 1}}
    drifted = {"pattern_id": "p2", "sample_size": "many", "tier_effectiveness": {}, "status": "inactive"}
    (tmp_path / "patterns.json").write_text(json.dumps([full, drifted], indent=2))
    (tmp_path / "lines.json").write_text(json.dumps(full) + "\n\n" + json.dumps(drifted) + "\n")
    (tmp_path / "broken.json").write_text("[{")
    for name, n in (("patterns.json", 2), ("lines.json", 2), ("broken.json", 0), ("*.json", 4)):
        assert D.read_documents(spark, f"{tmp_path}/{name}").count() == n
    found = D.with_defaults(D.read_documents(spark, f"{tmp_path}/patterns.json"))
    rows = {r["pattern_id"]: r for r in found.collect()}
    assert (rows["p1"]["recommended_metrics"], rows["p1"]["confidence_interval"], rows["p1"]["sample_size"], rows["p1"]["status"]) == ({"title_words": [8, 11]}, [0.0, 0.25], 15, "active")
    assert (rows["p2"]["applicable_subreddits"], rows["p2"]["sample_size"], rows["p2"]["p_value"], rows["p2"]["status"]) == ([], 0, 1.0, "inactive")
    low, high = D.metric_range("title_words")
    assert {tuple(r) for r in found.select("pattern_id", low, high).collect()} == {("p1", 8, 11), ("p2", None, None)}
    D.write_documents(found, str(tmp_path / "out"))
    again = {r["pattern_id"]: r for r in D.read_documents(spark, str(tmp_path / "out")).collect()}
    assert again == rows


def test_draft_checks_in_two_languages_and_times(spark):
    texts = ['{"passed": true, "dimensions": {"hook": 60.0}, "suggestions": ["x"]}', '{"是否通过": false, "各维度": {"hook": 25}, "改进建议": []}', "none", None]
    got = [r["check"] for r in D.draft_checks(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, self_check string")).orderBy("i").collect()]
    assert [(c["passed"], c["dimensions"], c["suggestions"]) for c in got] == [(True, {"hook": 60.0}, ["x"]), (False, {"hook": 25.0}, []), (None, None, None), (None, None, None)]
    times = spark.createDataFrame([(0, "2024-01-02T03:04:05"), (1, "2024-01-02T03:04:05+02:00"), (2, "2024-01-02T03:04:05Z"), (3, "soon"), (4, None)], "i long, t string")
    assert [str(r["t"])[11:16] for r in D.utc_times(times, "t").orderBy("i").select(F.date_format("t", "yyyy-MM-dd HH:mm").alias("t")).collect()] == ["03:04", "01:04", "03:04", "", ""]
