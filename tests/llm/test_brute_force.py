"""Whole queries against plain Python on the smallest tables; long texts; words and stems that were held out."""

import json
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tractionlens.llm.chat_format import as_tool_log, link_tool_calls, op8_chat_format
from tractionlens.llm.decontamination import decontaminate, op1_decontamination, tiles
from tractionlens.llm.language_id import chosen, identify, letter_words, train, word_costs, _grams, _padded
from tractionlens.llm.lm_scoring import score_texts
from tractionlens.llm.near_dedup import near_duplicates
from tractionlens.llm.packing import op4_packing, pack
from tractionlens.llm.quality_rules import quality_rules
from tractionlens.llm.shared import mix
from tractionlens.llm.substring_dedup import difference_cover, op10_substring_dedup, repeated_strings
from tractionlens.llm.toxicity import Ordinal, fit, op2_toxicity, toxicity
from tractionlens.llm.url_filters import RULES, labelled_hosts, labelled_urls, op7_url_filters, url_filter

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# ---------------------------------------------------------------- tiling


def plain_tiles(item, doc, least):
    """Greedy string tiling by trying every pair of positions for each tile."""
    free_item, free_doc, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = None
        for j in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_item[i + n] and free_doc[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, j, i)
        if not best:
            return out
        n, j, i = best
        free_item[i : i + n], free_doc[j : j + n] = [False] * n, [False] * n
        out.append((i, j, n))


def _tokens(values):
    return mix(np.asarray(values, np.uint64) + np.uint64(1))


def test_tiles_on_small_alphabets():
    rng = np.random.default_rng(0)
    for _ in range(200):
        item, doc = rng.integers(0, rng.integers(1, 4), rng.integers(1, 25)), rng.integers(0, rng.integers(1, 4), rng.integers(1, 40))
        least = min(int(rng.integers(1, 5)), len(item))
        assert tiles(_tokens(item), _tokens(doc), least) == plain_tiles(item.tolist(), doc.tolist(), least)
    assert tiles(_tokens(np.zeros(400)), _tokens(np.zeros(20_000)), 5) == [(0, 0, 400)]


def _bare(text):
    out = []
    for w in SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text)):
        marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
        while len(w) > 1 and w[-1] in marks:
            w = w[:-1]
        while len(w) > 1 and w[0] in marks:
            w = w[1:]
        out.append(w)
    return out


def plain_contaminated(texts, items):
    seeds = defaultdict(set)
    for k, item in enumerate(items):
        for i in range(len(item) - 4):
            seeds[tuple(item[i : i + 5])].add(k)
    out = []
    for text in texts:
        doc = _bare(text)
        here = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
        near = set().union(*[seeds.get(g, ()) for g in here] or [()])
        reach = lambda item: len({i + k for i in range(len(item) - 4) if tuple(item[i : i + 5]) in here for k in range(5)})
        near = {k for k in near if reach(items[k]) >= 0.6 * len(items[k])}  # tiles cover no more than all shared windows do
        out.append(any(sum(n for _, _, n in plain_tiles(items[k], doc, 5)) >= 0.6 * len(items[k]) for k in near))
    return out


def test_decontamination_query(spark, documents):
    items = [_bare(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    short = [(d, t) for d, t in documents if len(t) < 6_000]
    got = {r["doc_id"]: r["contaminated"] for r in op1_decontamination(spark, SF).collect()}
    assert len(got) == len(documents)
    want = plain_contaminated([t for _, t in short], items)
    assert [got[d] for d, _ in short] == want and any(want)


def test_short_items_and_blocks(spark):
    bench = spark.createDataFrame([(1, "alpha Beta"), (2, "one two three four five six"), (None, "gamma delta"), (3, "x")], "item_id long, text string")
    rows = [(7, "say alpha, beta now"), (7, "say alpha, beta now"), (7, "alpha x beta"), (None, "one two three four five six"), (None, "no"), (8, "the gamma delta"), (9, None)]
    for block in (1_000_000, 2):
        out = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_tokens=block).collect()
        assert sorted((str(r["doc_id"]), r["contaminated"], tuple(r["items"]), r["best_item"], r["n_tiles"]) for r in out) == sorted([
            ("7", True, (1,), 1, 1), ("7", True, (1,), 1, 1), ("7", True, (3,), 3, 1), ("None", True, (2,), 2, 1), ("None", False, (), None, 0), ("8", True, (), None, 1), ("9", False, (), None, 0),
        ])


# ---------------------------------------------------------------- repeated strings and groups


def test_difference_cover():
    for most in (1, 7, 24, 31, 62, 248):
        v, line = difference_cover(most)
        assert v <= max(most, 1) and {(int(a) - int(b)) % v for a in line for b in line} == set(range(v))


def plain_cut(texts, length, words):
    """Which bytes lie in strings of `length` bytes, and in those or passages of `words` words, that start twice."""
    data = [t.encode() for t in texts]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in data]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    said = Counter(tuple(b[a:e] for a, e in s[i : i + words]) for b, s in zip(data, spans) for i in range(len(s) - words + 1))
    for b, s in zip(data, spans):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        both = gone.copy()
        for i in range(len(s) - words + 1):
            if said[tuple(b[a:e] for a, e in s[i : i + words])] > 1:
                both[s[i][0] : s[i + words - 1][1]] = True
        yield b, gone, both


def test_substring_query(spark, documents):
    got = {r["doc_id"]: r for r in op10_substring_dedup(spark, SF).collect()}
    assert len(got) == len(documents)
    for (d, _), (b, gone, both) in zip(documents, plain_cut([t for _, t in documents], 400, 51)):
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["n_cut"]) == (len(b), gone.sum(), (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum(), both.sum())


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10_000, 200))
    a, b, c = text(), text(), text()
    rows = [(1, f"{a} end"), (1, f"{b} end"), (5, a), (9, b), (20, text()), (None, c), (None, c), (30, f"{c} z"), (None, text()), (40, None), (None, "")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in out) == sorted([
        ("1", "1", True), ("1", "1", True), ("5", "1", False), ("9", "1", False), ("20", "20", True), ("None", "30", False), ("None", "30", False),
        ("30", "30", True), ("None", "None", True), ("40", "40", True), ("None", "None", True),
    ])


def test_no_link_is_lost(spark):
    """Pairs of texts just at the threshold, long enough for sketches that are not whole sets."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(150):
        ws = [f"w{x}" for x in rng.integers(0, 1_000_000, 500)]
        changed = list(ws)
        for at in range(25, 25 + 11 * 3, 3):
            changed[at * 8 % 500] = "changed"
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(changed))]
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(496)} for d, t in rows}
    near = [i for i in range(150) if 100 * len(sets[2 * i] & sets[2 * i + 1]) >= 80 * len(sets[2 * i] | sets[2 * i + 1])]
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 100 and [i for i in range(150) if out[2 * i + 1] == 2 * i] == near


# ---------------------------------------------------------------- packing


def test_packing_query(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in op4_packing(spark, SF).collect():
        got[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for d, t in documents:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(got[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 2048)
            assert zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 1  # no packing has fewer than the total over the capacity


# ---------------------------------------------------------------- classifiers


def test_ordinal_gradient_and_grades():
    """More than two grades: the fit comes near the maximum of the likelihood that a plain search finds, thresholds in order."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(600):
        x = np.flatnonzero(rng.random(6) < 0.4).astype(np.int32)
        s = 2.0 * (x == 1).any() + 1.0 * (x == 2).any() + rng.logistic()
        rows.append((int((s > 0.5) + 0 + (s > 2.0)), x))
    model = fit(rows, 8, 0.0, 3_000, 0.0)
    assert model.theta[0] < model.theta[1] and model.weights[1] > model.weights[2] > 0.4

    def loss(w, theta):
        total = 0.0
        for y, x in rows:
            s = sum(w[k] for k in x)
            edge = [0.0, *(1 / (1 + math.exp(s - t)) for t in theta), 1.0]
            total -= math.log(max(edge[y + 1] - edge[y], 1e-12))
        return total / len(rows)

    best = loss(model.weights, model.theta)
    for k in range(6):
        for step in (-0.05, 0.05):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved, model.theta) > best - 1e-4
    for k in range(2):
        for step in (-0.05, 0.05):
            moved = model.theta.copy()
            moved[k] += step
            assert loss(model.weights, moved) > best - 1e-4


def test_toxicity_query(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in op2_toxicity(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["toxic"] == (r["severity"] >= 0.5) and r["grade"] == int(r["severity"] > 0.5) for r in got.values())
    assert np.mean([got[d]["toxic"] == bool(y) for d, y in labels.items() if d in got]) > 0.85


def test_kneser_ney_against_plain_counts():
    texts, order, discount = ["the cat sat on the mat", "that hat, the bat"], 3, 0.75
    words = [f"\0{w}\0" for t in texts for w in re.findall(r"[^\W\d_]+", t.lower())]
    symbols = {c for w in words for c in w}
    grams = [[(w[max(0, i - n + 1) : i + 1], i - n + 1 == 0) for w in words for i in range(n - 1, len(w))] for n in range(1, order + 1)]

    def prob(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(symbols) + 2)
        if n == order:
            counts = Counter(g for g, _ in grams[n - 1])
        else:
            counts = Counter(g[1:] for g in {g for g, _ in grams[n]})
            counts.update(g for g, first in grams[n - 1] if first)
            counts = Counter({g: c for g, c in counts.items() if not (n == 1 and g == "\0" and False)})
        if n == 1:
            counts = Counter(g[1:] for g in {g for g, _ in grams[1]})
        same = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return prob(gram[1:])
        return max(same.get(gram, 0) - discount, 0) / total + discount * len(same) / total * prob(gram[1:])

    model = train(texts, order, discount)
    for w in ("the", "cat", "thaz", "q", "bath"):
        padded = f"\0{w}\0"
        want = -sum(math.log(prob(padded[max(0, i - order + 1) : i + 1])) for i in range(1, len(padded)))
        codes, starts, ends, _ = letter_words([w])
        s, word = _padded(codes, starts, ends)
        got = word_costs([model], s, word, _grams(s, word, order), 1)[0][0]
        assert abs(got - want) < 1e-9, (w, got, want)


def test_training_rows_are_bounded_and_distinct(spark):
    rows = [(i % 7, f"text {i}", "en" if i % 3 else "fr") for i in range(300)] + [(1, "same", "en")] * 50
    out = chosen(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20, ranges=8).collect()
    assert Counter(r["lang"] for r in out) == {"en": 20, "fr": 20} and len({(r["lang"], r["text"]) for r in out}) == 40


def _plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), act, h + p) for act, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_query(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op7_url_filters(spark, SF).collect():
        host, path, act, rule = _plain_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (act or ("block" if r["block_score"] >= 0.5 else "allow"))


def test_urls_of_held_out_hosts(spark):
    """Every fifth host is kept from the training table; whole words may occur in it only inside other hosts."""
    hosts = labelled_hosts()
    table = labelled_urls(spark, [x for i, x in enumerate(hosts) if i % 5 != 2])
    rows = [(i, f"http://{h}.example.info/a/{i}") for i, (h, _) in enumerate(hosts) if i % 5 == 2]
    out = {r["page_id"]: r["verdict"] for r in url_filter(spark.createDataFrame(rows, "page_id long, url string"), table).collect()}
    right = [(out[i] == "block") == (hosts[i][1] == 1) for i, _ in rows]
    assert np.mean(right) > 0.9 and np.mean([ok for ok, (i, _) in zip(right, rows) if hosts[i][1] == 1]) > 0.85
    empty = spark.createDataFrame([], "page_id long, url string, host string, rule int")
    assert url_filter(empty, table).count() == 0


# ---------------------------------------------------------------- tool calls


def _fits(arguments):
    """The schema of the tool `answer` in plain Python."""
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    if not isinstance(arguments, dict) or set(arguments) - {"query", "turn", "limit", "style", "context"}:
        return False
    if not isinstance(arguments.get("query"), str) or not whole(arguments.get("turn")) or not whole(arguments.get("limit", 0)) or not isinstance(arguments.get("style", ""), str):
        return False
    context = arguments.get("context", {})
    return isinstance(context, dict) and not set(context) - {"turns"} and isinstance(context.get("turns", []), list) and all(map(whole, context.get("turns", [])))


def plain_links(log):
    """(conv_id, turn, kind, call_id, status, json) of rows whose conversation, turns and ids are given, and calls by id."""
    calls, answers, rows = {}, {}, []
    strings = lambda x: [x] if isinstance(x, str) else [y for y in x or [] if isinstance(y, str)]
    for r in sorted(log, key=lambda r: (r["conv_id"], r["turn"])):
        p = json.loads(r["text"]) if (r["text"] or "").startswith("{") else {}
        for c in p.get("tool_calls", []):
            arguments = json.loads(c["arguments"]) if isinstance(c["arguments"], str) else c["arguments"]
            parents = strings(c.get("depends_on"))
            shown = {"arguments": arguments, "id": c["id"], "name": c["name"], "type": "call"} | ({"depends_on": sorted(set(parents))} if parents else {})
            first = calls.setdefault((r["conv_id"], c["id"]), (r["turn"], parents))
            rows.append((r["conv_id"], r["turn"], "call", c["id"], "duplicate" if first[0] != r["turn"] else "" if _fits(arguments) else "invalid", shown))
        if "tool_call_id" in p:
            first = answers.setdefault((r["conv_id"], p["tool_call_id"]), r["turn"])
            rows.append((r["conv_id"], r["turn"], "result", p["tool_call_id"], "duplicate" if first != r["turn"] else "", {"content": p["content"], "id": p["tool_call_id"], "type": "result"}))
        if not p:
            rows.append((r["conv_id"], r["turn"], "message", None, "message", {"content": r["text"] or "", "role": r["role"], "type": "message"}))
    out = []
    for conv, turn, kind, ident, status, shown in rows:
        key = (conv, ident)
        if kind == "call" and not status:
            status = "ok" if key in answers else "unanswered"
        if kind == "result":
            status = "orphan" if key not in calls else status or "ok"
        out.append((conv, turn, kind, ident, status, json.dumps({k: v for k, v in shown.items() if v is not None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
    return out, calls


def plain_places(calls):
    """For each call the latest turn among itself and all it depends on; none on a cycle or behind one."""
    out, left = {}, dict(calls)
    while True:
        above = {key: [(key[0], p) for p in parents if (key[0], p) in calls] for key, (_, parents) in left.items()}
        found = {key: max([calls[key][0], *(out[p] for p in ps)]) for key, ps in above.items() if all(p in out for p in ps)}
        if not found:
            return out | dict.fromkeys(left)
        out |= found
        left = {key: c for key, c in left.items() if key not in found}


def test_tool_log_query(spark):
    """Rows, statuses and canonical JSON from plain Python over the log, and what the order promises."""
    sf = SF.replace("sf0.001", "sf0.01")
    log = as_tool_log(spark.read.parquet(f"{sf}/conversations.parquet")).collect()
    wanted, calls = plain_links(log)
    got = op8_chat_format(spark, sf).collect()
    assert sorted((tuple(r[x] for x in ("conv_id", "turn", "kind", "call_id", "status", "json")) for r in got), key=str) == sorted(wanted, key=str)
    assert {r["status"] for r in got} >= {"ok", "invalid", "duplicate", "orphan", "message", "unanswered"}
    assert any(len(c[1]) > 1 for c in calls.values())

    place = {(r["conv_id"], r["call_id"]): r["seq"] for r in got if r["kind"] == "call" and calls[r["conv_id"], r["call_id"]][0] == r["turn"]}
    latest, moved, webs = plain_places(calls), 0, 0
    for key, (turn, parents) in calls.items():
        for parent in ((key[0], p) for p in parents):
            if parent in calls and latest[key] is not None:
                assert place[parent] < place[key]
                moved += calls[parent][0] > turn
                webs += len(parents) > 1
    assert moved and webs
    for r in got:
        if r["kind"] == "result" and r["status"] == "ok":
            assert r["seq"] > place[r["conv_id"], r["call_id"]]
    per = Counter(r["conv_id"] for r in got)
    assert all(sorted(r["seq"] for r in got if r["conv_id"] == conv) == list(range(n)) for conv, n in list(per.items())[:40])


def test_order_over_several_parents(spark):
    """Random webs of calls, with cycles: every call that is neither on a cycle nor behind one comes after all its parents."""
    r = __import__("random").Random(4)
    rows, calls = [], {}
    for conv in range(30):
        n = r.randint(1, 9)
        for i in range(n):
            parents = [f"c{r.randrange(n)}" for _ in range(r.choice([0, 0, 1, 2, 3]))]
            calls[conv, f"c{i}"] = (i, parents)
            rows.append((conv, i, "a", json.dumps({"tool_calls": [{"id": f"c{i}", "name": "answer", "arguments": {"query": "q", "turn": i}, "depends_on": parents}]})))
    got = link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    place, latest = {(x["conv_id"], x["call_id"]): x["seq"] for x in got}, plain_places(calls)
    assert len(got) == len(rows) and {x["status"] for x in got} == {"unanswered"}
    for key, (_, parents) in calls.items():
        assert latest[key] is None or all(place[key[0], p] < place[key] for p in parents)
    assert any(v is None for v in latest.values())


def test_types_nulls_and_ids_of_calls(spark):
    call = lambda i, a, more="": '{"tool_calls":[{"id":%s,"name":"answer","arguments":%s%s}]}' % (i, a, more)
    good = '{"turn":7,"query":"q"}'
    rows = [
        (1, 0, call('"a"', '{"query":5,"turn":7}')),
        (1, 1, call('"b"', '{"query":"5","turn":"7"}')),
        (1, 2, call('"c"', '{"turn":7,"query":"q","context":{"turns":[1,2]}}', ',"depends_on":["a","b"]')),
        (1, 3, call('"d"', '{"turn":7.5,"query":"q"}')),
        (1, 4, call('"e"', '{"turn":7,"query":"q","context":{"turns":[1,"2"]}}')),
        (1, 5, call('"f"', '{"turn":7,"query":"q","context":{"more":1}}')),
        (1, 6, call("9", good)),
        (1, 7, '{"tool_call_id":"c","content":{"b":1.50,"a":[null,{"z":1,"y":2}]}}'),
        (1, None, call('"n"', good)),
        (1, None, '{"tool_call_id":"n","content":"r"}'),
        (1, 8, '{"a":1,"a":2}'),
        (None, 1, call('"q"', good)),
        (None, 2, '{"tool_call_id":"q"}'),
        (None, None, None),
    ]
    out = link_tool_calls(spark.createDataFrame([(c, t, "x", text) for c, t, text in rows], "conv_id long, turn long, role string, text string")).collect()
    status = {(r["conv_id"], r["kind"], r["call_id"]): r["status"] for r in out}
    assert [status[1, "call", x] for x in "abcdef"] == ["invalid", "invalid", "ok", "invalid", "invalid", "invalid"]
    assert status[1, "call", None] == "unanswered" and status[1, "call", "n"] == "ok" and status[1, "result", "n"] == "ok"
    assert status[None, "call", "q"] == "unanswered" and status[None, "result", "q"] == "orphan"
    shown = {(r["kind"], r["call_id"]): r["json"] for r in out if r["conv_id"] == 1}
    assert shown["call", "c"] == '{"arguments":{"context":{"turns":[1,2]},"query":"q","turn":7},"depends_on":["a","b"],"id":"c","name":"answer","type":"call"}'
    assert json.loads(shown["result", "c"])["content"] == '{"a":[null,{"y":2,"z":1}],"b":1.5}'
    assert {r["seq"] for r in out if r["conv_id"] is None} == {None} and sorted(r["seq"] for r in out if r["conv_id"] == 1) == list(range(11))


def test_long_chain_against_the_logs_order(spark):
    n = 200
    call = lambda i: '{"tool_calls":[{"id":"c%d","name":"answer","arguments":{"query":"x","turn":1}%s}]}' % (i, f',"depends_on":"c{i + 1}"' if i + 1 < n else "")
    rows = [(1, i, "assistant", call(i), "clash") for i in range(n)] * 2 + [(2, 0, "assistant", call(0), "clash")]
    out = link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _at string")).where("conv_id = 1").collect()
    first = {}
    for r in sorted(out, key=lambda r: r["seq"]):
        first.setdefault(r["call_id"], r["seq"])
    assert all(first[f"c{i}"] > first[f"c{i + 1}"] for i in range(n - 1)) and len(out) == 2 * n
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert link_tool_calls(empty).count() == 0


# ---------------------------------------------------------------- the pipeline, and long texts


def test_pipeline_against_brute_force(spark, documents):
    """Each stage over what the stage before it kept; then run() as a whole."""
    import duckdb

    from tractionlens.llm import near_dedup, quality_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    stage = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {d for d, k in con.execute(f"SELECT doc_id, kept FROM ({quality_rules.ORACLES['op3_quality_rules']})").fetchall() if k}
    one = stage["quality_rules"](spark, docs, SF).cache()
    assert texts(one).keys() == kept and one.columns == docs.columns

    con.execute("DROP VIEW documents")
    frame = one.toPandas()
    con.register("documents", frame)
    sql = near_dedup.ORACLES["op9_near_dedup"].replace("i + 3)", "i + 4)").replace("len(ws) - 3", "len(ws) - 4")
    kept = {d for d, k in con.execute(f"SELECT doc_id, kept FROM ({sql})").fetchall() if k}
    two = stage["near_dedup"](spark, one, SF).cache()
    assert texts(two).keys() == kept and len(kept) < one.count()

    before = texts(two)
    want = {}
    for d, (b, _, both) in zip(before, plain_cut(list(before.values()), 400, 51)):
        left = bytes(x for x, gone in zip(b, both) if not gone).decode("utf-8", "replace").replace("�", "")
        if left:
            want[d] = left
    three = stage["substring_dedup"](spark, two, SF).cache()
    assert texts(three) == want

    items = [_bare(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = plain_contaminated(list(want.values()), items)
    four = stage["decontamination"](spark, three, SF).cache()
    assert texts(four) == {d: t for (d, t), bad in zip(want.items(), dirty) if not bad} and four.columns == docs.columns
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    rows = lambda df: sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(pack(four))


MESSY = [(None, None, None), (None, "", "en"), (1, "  \n ", "en"), (2, "one", None), (2, "one", None), (None, "some words without an id", "fr")]


def test_stages_on_messy_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows, an empty table, and columns whose names the stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key long, sha string, row long, rep long, kept boolean"
    full = spark.createDataFrame([(d, t, lang, None, None, 1, "s", 2, 3, True) for d, t, lang in MESSY], schema)
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (full, full.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            want = {"quality_rules": 0, "near_dedup": n and 5, "substring_dedup": n and 5, "decontamination": n}[name]
            assert out.count() == want, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == n


@pytest.fixture(scope="module")
def with_long(spark):
    long = " ".join(f"word{i * 7919 % 1_000_003}." for i in range(400_000))  # 4.7 MB
    return spark.createDataFrame([(1, long, "en"), (2, long[2_000_000:2_001_000], "en"), (3, "short text", "en"), (4, long + " end", "en")], "doc_id long, text string, lang string")


LONG = {
    "op1": lambda d, s: decontaminate(d, s.createDataFrame([(1, "word0. word7919. word15838. word23757. word31676. word39595.")], "item_id long, text string")).where("contaminated"),
    "op2": lambda d, s: toxicity(d, s.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")),
    "op3": lambda d, s: quality_rules(d).where("kept").select("doc_id", "n_words"),
    "op4": lambda d, s: pack(d).groupBy("doc_id").agg(F.sum("length")),
    "op5": lambda d, s: score_texts(d, F.col("doc_id") == 2, steps=5, tokens=200, classes=16, d=8),
    "op6": lambda d, s: identify(d, d.limit(3)),
    "op9": lambda d, s: near_duplicates(d).where("component_id = 1"),
    "op10": lambda d, s: repeated_strings(d, words=51).where("n_removed > 0"),
}


@pytest.mark.parametrize("name", LONG)
def test_long_text(spark, with_long, name):
    want = {"op1": {1, 4}, "op3": {1, 2, 4}, "op9": {1, 4}, "op10": {1, 2, 4}}
    assert {r["doc_id"] for r in LONG[name](with_long, spark).collect()} == want.get(name, {1, 2, 3, 4})


def test_long_url_and_message(spark):
    url = "http://" + "a" * 100_000 + "/" + "b" * 200_000
    assert url_filter(spark.createDataFrame([(1, url)], "page_id long, url string")).first()["host"] == "a" * 100_000
    out = link_tool_calls(spark.createDataFrame([(1, 0, "user", "x" * 2_000_000)], "conv_id long, turn long, role string, text string")).first()
    assert len(out["json"]) > 2_000_000


@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_words_that_share_prefixes_score_as_alone(scale):
    from tractionlens.llm import lm_scoring as L

    rng = np.random.default_rng(4)
    p = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in L.started(np.ones(30), 12, 8, 6, 3).p.items()}
    p["u"] = p["u"] * np.float32(scale)
    words = [rng.integers(2, 5, n) for n in [0, 0, 1, 1, 2, 2, 3, 3, 3, 4, 5, 5, 5] * 3]
    words += [words[-1]] * 2  # repeated rows
    got = L._log10(p, np.concatenate(words), np.array([len(w) for w in words]), 6, tokens=16)
    for value, w in zip(got, words):
        z = L._forward(p, np.concatenate([[L.START], w]).astype(np.int64)[None])[0].astype(float)
        z -= z.max(1, keepdims=True)
        want = (z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(len(w) + 1), np.concatenate([w, [L.END]]).astype(int)].sum() / np.log(10)
        assert abs(value - want) < 1e-4 * max(1, abs(want))
