"""License scans, Merkle manifests and source divergence against plain Python, on messy tables and on the whole small one."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tractionlens.llm import license_scan as L
from tractionlens.llm import merkle_manifest as M
from tractionlens.llm import source_divergence as S

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, grp string, words string, term string, n long"
LONG = "word " * 60_000 + "Released under the MIT License. " + "Wort " * 60_000
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
ROWS = [
    (1, "Released under the MIT License.\nCC BY NC, cc by-nc; CC BY-NC-SA 4.0", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, "a", 0),
    (None, "licensed under the Apache License,\nVersion 2.0\n", "en", None, 3),
    (None, "licensed under the Apache License,\nVersion 2.0\n", "en", None, 3),
    (5, MIT, "de", "b", 4),
    (5, MIT.replace("to deal in", "to trade freely in").replace("publish, ", ""), "de", "b", 4),
    (5, MIT, "de", "b", 4),
    (7, "GNU General Public License version 3; the GNU Lesser General Public License", "de", "", 5),
    (8, "cc by", "de", "", 5),
    (9, LONG, "en", "hot", 5),
    (-4, "Käse äää KÄSE é9x Kelvin under the mit license under the mit license", "fr", "é", 5),
    *[(100 + i, f"same words\nhere {'x' * (i % 7)} and Ä{i % 3}", ["en", "de"][i % 2], "hot", i) for i in range(60)],
]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "t", 1) for r in ROWS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=str)


# ---------------------------------------------------------------- licenses


def plain_scan(rows, phrases, templates, k=3, share=0.7, width=8):
    out = []
    for doc_id, text, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels, base_labels, best = [], set(), set(), 0.0
        for label, phrase in phrases:
            want = phrase.split()
            for at in range(len(words) - k + 1):
                if words[at : at + len(want)] == want:
                    places.append(at)
                    base_labels.add(label)
            grams = [want[i : i + k] for i in range(len(want) - k + 1)]
            for at in range(len(words) - k + 1):
                for i, g in enumerate(grams):
                    if words[at : at + k] == g:
                        best = max(best, sum(words[at - i + j : at - i + j + k] == h for j, h in enumerate(grams) if at - i + j >= 0) / len(grams))
        for label, template in templates:
            want = template.split()
            grams = [want[i : i + k] for i in range(len(want) - k + 1)]
            bands = defaultdict(set)
            for at in range(len(words) - k + 1):
                for i, g in enumerate(grams):
                    if words[at : at + k] == g:
                        for band in (0, 1):
                            bands[(at - i) // width - band].add(i)
            for found in bands.values():
                best = max(best, len(found) / len(grams))
                if len(found) >= (len(grams) if len(grams) <= 12 else share * len(grams)):
                    labels.add(label)
        ends = (min(places), max(places)) if places else (None, None)
        out.append((doc_id, len(words), len(places), *ends, ",".join(sorted(base_labels)), ",".join(sorted(labels | base_labels)), round(best, 9)))
    return out


def _scanned(df):
    return _sorted((*r[:7], round(r[7], 9)) for r in df.drop("spans").collect())


def test_license_scan_of_messy_rows(messy):
    got = _scanned(L.license_scan(messy))
    assert got == _sorted(plain_scan(ROWS, L.PHRASES, L.TEMPLATES))
    labels = {r[0]: r[6] for r in got}
    assert labels[1] == "cc-by-nc,mit" and labels[5] == "mit" and labels[7] == "gpl-3,lgpl" and labels[8] == ""
    assert sum(r[6] == "apache-2" for r in got) == 2 and sum(r[0] == 5 and r[6] == "mit" for r in got) == 3


def test_license_scan_of_an_empty_table(empty):
    assert L.license_scan(empty).count() == 0


def test_license_query(spark, documents):
    assert _scanned(L.op11_license_scan(spark, SF)) == _sorted(plain_scan(documents, L.PHRASES, L.TEMPLATES))


def test_license_spans_and_own_templates(spark):
    docs = spark.createDataFrame([(1, "a b c d e f x c d e f g h i j k l m n o p")], "doc_id long, text string")
    words = "a b c d e f g h i j k l m n o p"
    row = L.license_scan(docs, phrases=(("two", "c d e"),), templates=(("all", words),)).first()
    assert (row["n_base"], row["first_word"], row["last_word"], row["labels"], row["score"]) == (2, 2, 7, "all,two", 1.0)
    assert [tuple(s) for s in row["spans"] if s["label"] == "all"][0][:3] == ("all", 0, 20)
    with pytest.raises(ValueError):
        L.template_grams((("x", "two words"),), ())


# ---------------------------------------------------------------- manifest


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return _hash(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_hash(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def plain_manifest(rows, arity=3):
    """(doc_id, leaf, subroot, root, proof, folded root, verified), where even ids lose their line breaks."""
    groups = defaultdict(list)
    for r in rows:
        groups["0" if r[3] is None else "1" + r[3]].append(r)
    trees = {}
    for name, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
        trees[name] = _levels([_leaf(r, r[1]) for r in members], arity)
    names = sorted(groups, key=lambda x: x.encode())
    top = _levels([trees[n][-1][0] for n in names], arity)
    out = []
    for i, name in enumerate(names):
        for at, r in enumerate(groups[name]):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node, proof = _leaf(r, text), []
            for levels, place in ((trees[name], at), (top, i)):
                for level in levels[:-1]:
                    first = place // arity * arity
                    run = level[first : first + arity]
                    proof += [x for j, x in enumerate(run) if first + j != place]
                    run[place - first] = node
                    node, place = _hash(*run), place // arity
            out.append((r[0], _leaf(r, r[1]), trees[name][-1][0], top[-1][0], _hash(*proof), node, node == top[-1][0]))
    return out


def _even(text="text"):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.translate(text, "\n", ""))


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_of_messy_rows(messy, levels):
    got = M.merkle_manifest(messy, levels=levels, tampered=_even()).drop("witness").collect()
    assert _sorted(got) == _sorted(plain_manifest(ROWS))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_other_shapes(spark, empty):
    assert M.merkle_manifest(empty).count() == 0
    one = spark.createDataFrame([(1, "x", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    row = M.merkle_manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["verified"] and row["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    rows = [(i, f"t{i}\n", "en", f"s{i % 11}", i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert _sorted(M.merkle_manifest(docs, levels=1, tampered=_even()).drop("witness").collect()) == _sorted(plain_manifest(rows))
    assert _sorted(M.merkle_manifest(docs, arity=5, levels=2, tampered=_even()).drop("witness").collect()) == _sorted(plain_manifest(rows, 5))


def test_manifest_query(spark, documents):
    assert _sorted(M.op12_merkle_manifest(spark, SF).collect()) == _sorted(plain_manifest(documents))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28])
def test_appended_witnesses_grow_with_siblings(n):
    tree = M.Appender(3)
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    for leaf in leaves:
        tree.append(leaf)
    root = tree.finish()
    assert root.hex() == _levels([x.hex() for x in leaves], 3)[-1][0]
    assert all(M.folded(leaf, bytes(w)) == root for leaf, w in zip(leaves, tree.witnesses))
    assert n == 1 or M.folded(leaves[0], bytes(tree.witnesses[-1])) != root


# ---------------------------------------------------------------- divergence


def plain_divergence(rows, least=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=lambda t: t.encode())
        v = len(kept)
        size = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda count, n: 1 + 10**9 * (count + 2) // (n + 2 * v)
        p = {s: [share(counts[lang, s][t], size[s]) for t in kept] for s in sources}
        q = [share(sum(counts[lang, s][t] for s in sources), sum(size.values())) for t in kept]
        far = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(sum(map(far, p[s], p[o])), o) for o in sources if o != s]
            terms = [(far(a, b), t) for t, a, b in zip(kept, p[s], q) if counts[lang, s][t] and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1) if part == "pair" or i <= top]
    return out


@pytest.mark.parametrize("shard_terms, block", [(20_000, 64), (2, 1)])
def test_divergence_of_messy_rows(messy, shard_terms, block):
    for least in (1, 10):
        got = S.source_divergence(messy, least=least, shard_terms=shard_terms, block=block).collect()
        assert _sorted(got) == _sorted(plain_divergence(ROWS, least))


def test_divergence_of_an_empty_table(empty):
    assert S.source_divergence(empty).count() == 0


def test_divergence_query(spark, documents):
    assert _sorted(S.op13_source_divergence(spark, SF).collect()) == _sorted(plain_divergence(documents))


def test_shares_are_exact_beyond_64_bits():
    r = random.Random(5)
    for _ in range(300):
        total = r.randint(1, 9 * 10**15)
        count = r.randint(0, total)
        assert int(S.share(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * count // total


@pytest.mark.parametrize("leaf", [1, 3, 1 << 15])
def test_runs_of_sorted_pointers(monkeypatch, leaf):
    monkeypatch.setattr(S, "_LEAF", leaf)
    for seed in range(40):
        r = random.Random(seed)
        texts = ["".join(r.choice("aab c  éß") for _ in range(r.randint(0, 60))) for _ in range(r.randint(0, 9))] + ["aaaaaaaab" * 9 + " aaaaaaaa aaaaaaaab aaaaaaaa"]
        data, offs = "".join(texts).encode(), np.cumsum([0] + [len(t.encode()) for t in texts])
        groups = np.array([r.randint(0, 2) for _ in texts], np.int64)
        want, holders = Counter(), defaultdict(set)
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t):
                want[w, int(groups[i])] += 1
                holders[w, int(groups[i])].add(i)
        terms, group, n_docs, n = S.runs(np.frombuffer(data, np.uint8), offs, groups)
        got = [(t, int(g), int(d), int(c)) for t, g, d, c in zip(terms.to_pylist(), group, n_docs, n)]
        assert sorted(got) == sorted((*k, len(holders[k]), c) for k, c in want.items())
        assert [t for t, *_ in got] == sorted((t for t, *_ in got), key=str.encode)


@pytest.mark.parametrize("module, name", [(L, "op11_license_scan"), (M, "op12_merkle_manifest"), (S, "op13_source_divergence")])
def test_against_sql(spark, module, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found, wanted = module.QUERIES[name](spark, SF), con.sql(module.ORACLES[name])
    assert set(found.columns) == set(wanted.columns)
    as_rows = lambda rows: _sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    assert as_rows(found.select(*wanted.columns).collect()) == as_rows(wanted.fetchall())
