"""Every operator on nulls, empty and repeated rows, empty tables and clashing columns; and against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tractionlens.llm import shared
from tractionlens.llm.chat_format import link_tool_calls
from tractionlens.llm.decontamination import decontaminate
from tractionlens.llm.language_id import identify
from tractionlens.llm.lm_scoring import dealt_words, op5_lm_scoring, score_texts, started, train_rounds, word_counts
from tractionlens.llm.near_dedup import near_duplicates
from tractionlens.llm.packing import fullest, pack, plan
from tractionlens.llm.quality_rules import quality_rules
from tractionlens.llm.substring_dedup import repeated_strings
from tractionlens.llm.subwords import default_path, encoder
from tractionlens.llm.toxicity import toxicity
from tractionlens.llm.url_filters import url_filter

WORDS = "the rain in spain falls mainly on a plain where old trees stand and many small birds sing all day long".split()
LONG = " ".join(f"{w}{i}" for i in range(40) for w in WORDS)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, sha string, row long, _words string"


def docs(spark, texts):
    rows = [(i, t, "en" if i and i % 2 else "fr", "src0", 0, 7, "x", 3, "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def messy(spark):
    return docs(spark, [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (5, LONG), (6, "one"), (7, "É" * 300), (None, "no id at all"), (8, LONG[:3000] + " more")])


def test_quality_edges(messy):
    out = {r["doc_id"]: r for r in quality_rules(messy, carry=True).collect()}
    assert not out[1]["kept"] and out[1]["n_words"] == 0 and out[1]["clean_text"] == ""
    assert out[4]["kept"] and out[4]["n_repeat_words"] == 0 and out[4]["input_row"]["source"] == "src0"
    assert quality_rules(messy.limit(0)).count() == 0


def test_quality_lines(spark):
    good = " ".join(WORDS * 3) + "."
    out = quality_rules(docs(spark, [(1, f"{good.replace('the', 'a1')}\nHome\nAll rights reserved\nx !!! ??? !!!")]), min_words=5, max_repeat_percent=100).first()
    assert out["n_failed_lines"] == 3 and out["clean_text"].count("\n") == 0 and out["kept"]


def test_packing(spark, messy):
    out = pack(messy, capacity=64).collect()
    enc = encoder(default_path())
    for r in out:
        assert 0 < r["length"] <= 64
    one = [r for r in out if r["doc_id"] == 1]
    assert len(one) == 1 and one[0]["length"] == 1 and one[0]["ids_crc32"] == zlib.crc32(bytes(4))
    data = enc.packed(LONG) + bytes(4)
    four = sorted((r for r in out if r["doc_id"] == 4), key=lambda r: r["piece"])
    assert sum(r["length"] for r in four) == len(data) // 4 and all(r["length"] == 64 for r in four[1:])
    assert all(zlib.crc32(data[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for r in four)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(messy.limit(0)).count() == 0


def test_fullest_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = {int(x): int(n) for x, n in zip(rng.integers(1, 40, 5), rng.integers(1, 4, 5))}
        room = int(rng.integers(5, 100))
        reach = {0}
        for x, n in counts.items():
            reach = {s + k * x for s in reach for k in range(n + 1) if s + k * x <= room}
        got = fullest(counts, room)
        assert sum(x * n for x, n in got.items()) == max(reach) and all(n <= counts[x] for x, n in got.items())
    bins = plan({30: 3, 20: 4, 10: 5}, 50)
    used = {}
    for fill, times in bins:
        assert sum(x * n for x, n in fill.items()) <= 50
        for x, n in fill.items():
            used[x] = used.get(x, 0) + n * times
    assert used == {30: 3, 20: 4, 10: 5}


@pytest.mark.parametrize("text", ["a  b", "x \n y", "it's 12 o'clock,  <|endoftext|> é!!", "", " lead", "tail ", "a\n\n b\tc", "Hello,world. «quoi» ñandú 你好"])
def test_subwords_equal_tokenizer(text):
    enc = encoder(default_path())
    assert np.frombuffer(enc.packed(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_near_duplicates_against_brute_force(spark, messy):
    near = LONG.replace("rain3 ", "snow3 ")
    table = messy.union(docs(spark, [(20, near), (21, "a b c d"), (22, "A B c d"), (23, "a b c d e")]))
    out = {r["doc_id"]: r for r in near_duplicates(table, k=4).collect()}
    assert [out[i]["component_id"] for i in (4, 5, 20, 21, 22, 23, 1, 2)] == [4, 4, 4, 21, 21, 23, 1, 2]
    assert out[1]["n_shingles"] == 0 and out[21]["n_shingles"] == 1 and not out[5]["kept"]
    assert near_duplicates(messy.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    out = {r["id"]: r["component"] for r in shared.components(links).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_repeated_strings_against_brute_force(spark, messy):
    rng = np.random.default_rng(5)
    pieces = ["".join(rng.choice(list("abé "), 30)) for _ in range(12)]
    texts = [(i, "".join(rng.choice(pieces, 14)) if i % 5 else "z" * (20 + i)) for i in range(30, 60)]
    table = messy.union(docs(spark, texts))
    length = 40
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in table.select("doc_id", "text").collect()]
    seen = {}
    for _, b in rows:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    want = []
    for d, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((str(d), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = [(str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_strings(table, length=length, slice_bytes=4000, bucket_strings=500).collect()]
    assert sorted(got) == sorted(want)
    assert repeated_strings(messy.limit(0)).count() == 0


def test_repeated_words_against_brute_force(spark, messy):
    rng = np.random.default_rng(6)
    pieces = [" ".join(rng.choice(list("abcdefg"), 5)) for _ in range(40)]
    gaps = [" ", "  ", "\n"]
    texts = [(i, "".join(f"{p}{rng.choice(gaps)}" for p in rng.choice(pieces, 9)) + "é" * int(rng.integers(0, 30))) for i in range(30, 60)]
    table = messy.union(docs(spark, texts))
    length, words = 60, 11
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in table.select("doc_id", "text").collect()]
    spans = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^ \t-\r]+", b)] for _, b in rows]
    seen, copies = {}, {}
    for (_, b), ws in zip(rows, spans):
        copies[b] = copies.get(b, 0) + 1
        for key in [b[i : i + length] for i in range(len(b) - length + 1)] + [tuple(w for _, _, w in ws[i : i + words]) for i in range(len(ws) - words + 1)]:
            seen[key] = seen.get(key, 0) + 1
    want = []
    for (d, b), ws in zip(rows, spans):
        gone = np.full(len(b), copies[b] > 1 and (len(b) >= length or len(ws) >= words))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        for i in range(len(ws) - words + 1):
            if seen[tuple(w for _, _, w in ws[i : i + words])] > 1:
                gone[ws[i][0] : ws[i + words - 1][1]] = True
        want.append((str(d), len(b), int(gone.sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = repeated_strings(table, length=length, words=words, slice_bytes=1000, bucket_strings=500).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)
    assert len({w[2] for w in want}) > 5


def test_pipeline_cuts_passages_of_51_words(spark):
    passage = " ".join(f"w{i:03}x" for i in range(51))
    assert 300 <= len(passage) < 400
    own = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    fifty = " ".join(f"v{i}" for i in range(50))
    table = docs(spark, [(i, f"{own[i]} {passage} end{i}" if i < 2 else f"{own[i]} {fifty} end{i}") for i in range(4)])
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.substring_dedup(spark, table, "").collect()}
    assert out == {i: f"{own[i]}  end{i}" if i < 2 else f"{own[i]} {fifty} end{i}" for i in range(4)}


def test_repeated_strings_without_ids(spark):
    shared_part, own = "x y z " * 20, ["first text", "second text", "third text"]
    out = repeated_strings(docs(spark, [(None, own[0] + shared_part), (None, own[1] + shared_part), (9, own[2])]), length=100).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"] - r["n_removed"]) for r in out) == [("9", 10), ("None", 5), ("None", 6)]  # " text" is shared too


def test_pipeline_keeps_documents_without_id(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda stage, rows: sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs(spark, rows), str(tmp_path)).collect()), key=str)
    alone, other = LONG.replace("3", "x"), LONG.replace("a", "e")
    near = [(None, None), (None, ""), (None, ""), (4, LONG), (None, LONG), (None, alone), (None, alone), (None, other), (7, other)]
    assert run(corpus_pipeline.near_dedup, near) == sorted([(None, None), (None, ""), (None, ""), (4, LONG), (None, alone), (7, other)], key=str)
    passage = " ".join(f"w{i:03}x" for i in range(51))
    assert run(corpus_pipeline.substring_dedup, [(None, f"one {passage} two"), (3, f"three {passage} four"), (None, "five")]) == [(3, "three  four"), (None, "five"), (None, "one  two")]
    assert run(corpus_pipeline.decontamination, [(None, f"x {item} y"), (None, "clean text"), (None, None), (2, item)]) == [(None, "clean text"), (None, None)]
    good = " ".join(LONG.split()[:200]) + "."
    assert [i for i, _ in run(corpus_pipeline.quality, [(None, good), (1, good)])] == [1, None]
    assert [r["doc_id"] for r in corpus_pipeline.packing(spark, docs(spark, [(None, "some text")]), "").collect()] == [None]


def test_decontamination_reordered(spark, messy):
    item = " ".join(f"q{i}" for i in range(20))
    swapped = "zz " + " ".join(f"Q{i}," for i in range(10, 20)) + " filler words here " + " ".join(f"q{i}" for i in range(10))
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "too short", 0), (None, item, 0)], "item_id long, text string, doc_id long")
    table = messy.union(docs(spark, [(40, swapped), (41, "x " + " ".join(f"q{i}" for i in range(8)))]))
    for block in (1_000_000, 3):
        out = {r["doc_id"]: r for r in decontaminate(table, bench, block_tokens=block).collect()}
        assert out[40]["contaminated"] and out[40]["coverage"] == 1.0 and out[40]["items"] == [1] and out[40]["best_item"] == 1
        assert not out[41]["contaminated"] and abs(out[41]["coverage"] - 0.4) < 1e-9 and not out[1]["contaminated"]
    assert decontaminate(messy, bench.limit(0)).where("contaminated").count() == 0


def test_toxicity_held_out(spark, messy):
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        ws = list(rng.choice(WORDS, 30)) + (["vilewordx"] * (1 + i % 3) + ["rottenwordy"] * (i % 2) if bad else [])
        texts.append((i, " ".join(rng.permutation(ws))))
        if i < 400:
            labels.append((i, int(bad)))
    out = {r["doc_id"]: r["toxic"] for r in toxicity(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert np.mean([out[i] == (i % 4 == 0) for i in range(400, 600)]) > 0.95
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(messy, empty).where("toxic").count() == 0


def test_language_held_out(spark, messy):
    a, b = "ka lo mi tru sen".split(), "zzu wix qor plaa enth".split()
    rng = np.random.default_rng(1)
    make = lambda s: " ".join("".join(rng.choice(s, 3)) for _ in range(30))
    table = docs(spark, [(i, make(a if i % 2 else b)) for i in range(80)])
    out = {r["doc_id"]: r for r in identify(table.union(messy), table.where("doc_id < 60")).collect()}
    assert all(out[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(60, 80))
    assert out[1]["lang_pred"] == "und" and out[3]["score"] == 0 and out[3]["rejected"]
    assert identify(messy, table.limit(0)).where("lang_pred <> 'und'").count() == 0


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.COM/en/x"), (2, "http://www.example.com/en/"), (3, "http://x.net/es/1"), (4, None), (5, "nothing"), (6, "http://good.net/?q"), (7, "https://casino-win.example.org/en/4"), (8, "https://garden.example.org/en/4"), (8, "http://h.com#frag")]
    out = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()), key=str)
    assert out[0] == (1, "a.example.com", "/en/x", "example.com/en/", "block") and out[1][3:] == ("www.example.com/en/", "allow")
    assert out[2][3:] == ("net/es/", "block") and out[3][1:4] == ("", "", None) and out[4][1:4] == ("", "", None)
    assert out[5][1:4] == ("good.net", "/", None) or out[5][1:4] == ("good.net", "", None)
    assert out[6][4] == "block" and {x[4] for x in out[7:]} == {"allow"}


def test_tool_calls(spark):
    call = lambda i, dep=None, args='{"query":"x","turn":1}': '{"tool_calls":[{"id":"%s","name":"answer","arguments":%s%s}]}' % (i, args, f',"depends_on":"{dep}"' if dep else "")
    rows = [
        (1, 0, "assistant", call("b", "a")),
        (1, 1, "tool", '{"tool_call_id":"b","content":"rb"}'),
        (1, 2, "assistant", call("a")),
        (1, 3, "tool", '{"tool_call_id":"a","content":"ra"}'),
        (1, 4, "assistant", call("c", None, '{"turn":"one"}')),
        (1, 5, "user", None),
        (1, 6, "tool", '{"tool_call_id":"zz","content":"lost"}'),
        (2, 0, "assistant", call("x", "y")),
        (2, 1, "assistant", call("y", "x")),
        (None, 0, "user", "hello {"),
    ]
    out = link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    one = sorted((r for r in out if r["conv_id"] == 1), key=lambda r: r["seq"])
    assert [r["seq"] for r in one] == list(range(len(one)))
    place = {(r["kind"], r["call_id"]): r["seq"] for r in one}
    assert place["call", "a"] < place["call", "b"] < place["result", "b"] and place["call", "a"] < place["result", "a"]
    status = {(r["kind"], r["call_id"]): r["status"] for r in one}
    assert status["call", "c"] == "invalid" and status["result", "zz"] == "orphan" and status["call", "a"] == "ok"
    assert [r["json"] for r in one if r["call_id"] == "a"][0] == '{"arguments":{"query":"x","turn":1},"id":"a","name":"answer","type":"call"}'
    assert len([r for r in out if r["conv_id"] == 2]) == 2 and len(out) == len(rows)


def test_scores_add_up(spark, messy):
    out = score_texts(messy, F.col("doc_id") == 8, steps=20, tokens=400, top_words=50).collect()
    counts, n = {}, 0
    rows = [(r["doc_id"], (r["text"] or "").lower().split()) for r in messy.select("doc_id", "text").collect()]
    for d, ws in rows:
        if d != 8:
            n += len(ws) + 1
            for w in [*ws, None]:
                counts[w] = counts.get(w, 0) + 1
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    for d, ws in rows:
        if d in (4, 8, 1, 6):
            r = got[d]
            assert (r["n_tokens"], r["train_tokens"]) == (len(ws) + 1, n)
            assert r["n_known"] == sum(w in counts for w in ws) + 1
            want = sum(np.log10((counts.get(w, 0) + 1) / (n + len(counts) + 1)) for w in [*ws, None])
            assert abs(r["base_score"] - want) < 1e-6 and np.isfinite(r["score"]) and r["score"] < 0


def test_model_learns_from_all_training_texts(spark):
    """The model must know ids and words that occur outside the sample it starts from."""
    enc = encoder(default_path())
    table = docs(spark, [(i, "plain words " * 20) for i in range(20)] + [(100, "Zebra quilts " * 400), (101, None)])
    counts = {(r["id"], r["w"]): r["c"] for r in word_counts(table, default_path()).collect()}
    want = {}
    for w, n in (("plain", 400), ("words", 400), ("zebra", 400), ("quilts", 400)):
        for i in np.frombuffer(enc.packed(" " + w), "<u4").tolist():
            want[i] = want.get(i, 0) + n
    assert {w: c for (of_id, w), c in counts.items() if of_id} == want and counts[False, 0] == 22
    ids = np.zeros(enc.tokenizer.get_vocab_size())
    ids[list(want)] = list(want.values())
    model = started(ids, 64, 8, 16, 1)
    assert all(model.slot[i] > 2 for i in want)
    both = word_counts(table, default_path())
    words = dealt_words(both, 1622, 5, 2)
    kept = words.collect()
    assert {bytes(r["spelled"]) for r in kept} == {b"", *(enc.packed(" " + w) for w in ("plain", "words", "zebra", "quilts"))}
    assert len({r["shard"] for r in kept}) == 3 and abs(sum(r["mass"] for r in kept) - 1622) < 1e-6
    more = train_rounds(words, 1622, model, 16, 2, 10, 200, 1)
    assert all((more.p[k] != model.p[k]).any() for k in ("e", "u", "wq"))
    assert train_rounds(words.limit(0), 0, model, 16, 2, 10, 200, 1) is model
    few = score_texts(table, F.col("doc_id") == 100, steps=10, tokens=200, classes=64, d=8).collect()
    all_texts = score_texts(table.union(docs(spark, [(102, "zebra quilts " * 400)])), F.col("doc_id") == 100, steps=10, tokens=200, classes=64, d=8).collect()
    score = lambda rows: next(r["score"] for r in rows if r["doc_id"] == 100)
    assert score(all_texts) > score(few) / 2


def test_scores_do_not_depend_on_partitions(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    rows = table.select("doc_id", "text").collect()
    found = []
    for parts in (1, 2, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        out = score_texts(df, F.col("doc_id") % 7 == 2, steps=30, tokens=300, classes=128, d=16, rounds=3, shard_words=2_000).collect()
        found.append({r["doc_id"]: (r["base_score"], r["score"]) for r in out})
    for other in found[1:]:
        assert all(np.allclose(other[k], found[0][k], rtol=1e-5, atol=1e-3) for k in found[0])
    assert abs(sum(x[1] for x in found[0].values()) - sum(x[1] for x in found[2].values())) < 1e-2


def test_lm_query_counts(spark):
    """The query on the smallest table: rows, counts and base scores from plain Python; scores finite and better than uniform."""
    sf = "/root/testdata/sf0.001"
    out = {r["doc_id"]: r for r in op5_lm_scoring(spark, sf).collect()}
    rows = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    counts = {}
    for d, ws in rows:
        for w in [*ws, None] if not held(d) else []:
            counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values())
    assert len(out) == len(rows)
    for d, ws in rows:
        r = out[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d), len(ws) + 1, sum(w in counts for w in [*ws, None]), n)
        assert abs(r["base_score"] - sum(np.log10((counts.get(w, 0) + 1) / (n + len(counts) + 1)) for w in [*ws, None])) < 1e-6 * (len(ws) + 1)
        assert np.isfinite(r["score"]) and -12 < r["score"] / r["n_tokens"] < 0


def test_tables_between_steps_take_the_denser_codec(spark):
    """The disk that stages fill is bounded; tables in the shared folder are written with zstd."""
    from tractionlens.llm.shared import written

    files = written(spark.range(5), "codec").inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_counting_and_training_tasks_hold_little(spark):
    """A counting task keeps few chunks, whatever the number of distinct words; a training task takes rows in any order and in pieces."""
    import pyarrow as pa

    from tractionlens.llm import subwords

    class Tasks:
        def select(self, *_):
            return self

        groupBy = select

        def mapInArrow(self, task, schema):
            self.task = task
            return spark.createDataFrame([], schema)

        applyInArrow = mapInArrow

    tasks = Tasks()
    word_counts(tasks, default_path())
    text = pa.array([" ".join(f"w{i:x}q{i % 7} The the" for i in range(first, first + 5_000)) for first in range(0, 100_000, 5_000)])
    chunks = lambda: sum(len(e.cache) for e in subwords._ENCODERS.values())
    before, found = chunks(), {}
    for out in tasks.task([pa.RecordBatch.from_arrays([text], names=["text"])]):
        for is_id, w, c, spelled in zip(*(x.to_pylist() for x in out.columns)):
            if not is_id:
                assert w not in found
                found[w] = (c, spelled)
    assert chunks() - before <= 1 << 16
    assert len(found) == 100_002 and sum(c for c, _ in found.values()) == 300_020 and found[0][0] == 20
    assert (200_000, encoder(default_path()).packed(" the")) in found.values()

    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 50_000, i % 20).astype("<u4").tobytes() for i in range(2_000)]
    whole = pa.table({"shard": np.zeros(len(ids), np.int32), "w": np.arange(len(ids)), "spelled": pa.array(ids, pa.binary()), "mass": 1.0 + np.arange(len(ids)) % 3})
    train_rounds(tasks, 4_000, started(np.ones(50_300), 64, 8, 16, 1), 16, 1, 20, 200, 1)
    mixed = whole.take(pa.array(rng.permutation(len(ids))))
    pieces = pa.concat_tables([mixed.slice(0, 700), mixed.slice(700, 1), mixed.slice(701)])
    assert tasks.task((pa.scalar(0),), pieces).equals(tasks.task((pa.scalar(0),), whole))
