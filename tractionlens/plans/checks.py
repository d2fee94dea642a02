"""Queries of draft checks, reasons of failures, parsed answers, matching and the gate, with their SQL; importing registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractionlens.functions import drafts as D
from tractionlens.functions import text as T
from tractionlens.operators import mining as M
from tractionlens.operators import validation as V
from tractionlens.plans.more import _HO, _KEYS, _READ, _TPL, _rounded
from tractionlens.plans.registry import _BW, _CHI, _CL, _FEAT, _TH, _TW, ORACLES, _add, _any, _hits, _q
from tractionlens.sources import posts as S
from tractionlens.sources.storage import written

c = F.col

# ---------------------------------------------------------------- drafts
_SIGNALS = "CASE hook " + " ".join(f"WHEN '{k}' THEN {_hits('{0}', v)}" for k, v in D.HOOK_SIGNALS.items()) + " ELSE 0 END"
_PRESENCE = "(SELECT CASE WHEN s >= 3 THEN 100 WHEN s >= 1 THEN 60 ELSE 25 END FROM (SELECT {0} AS s))"


def _presence(text: str) -> str:
    return _PRESENCE.format(_SIGNALS.replace("{0}", text))


_HOOKED = lambda p: p.withColumn("hook", T.hook_type(c("title")))
_GENERIC = _any("{0}", D.GENERIC)
_add("t19_title_checks", lambda p: _HOOKED(p).withColumn("k", D.title_check(c("title"), c("hook"))).select("post_id", "k.*"), f"""WITH {_FEAT}, s AS (SELECT post_id, title_words AS n, CASE WHEN title_words BETWEEN 5 AND 25 THEN 100 WHEN title_words BETWEEN 3 AND 30 THEN 70 ELSE 30 END AS words,
 {_presence("(title || ' ')")} AS hook, greatest(0, 100 - 30 * ((title_words < 5)::INT + (title_words > 30)::INT + {_GENERIC.replace("{0}", "title")}::INT)) AS anti FROM f)
SELECT post_id, words, hook, "anti", round((words * 3 + hook * 4 + "anti" * 3)::DOUBLE / 10, 1) AS overall FROM s""")
_FLAT = ("title_length", "body_length", "readability", "hook", "anti", "passed")
_draft = lambda p: _HOOKED(p).withColumn("k", D.draft_check(c("title"), c("body"), c("hook"), F.lit(6), F.lit(14), F.lit(50), F.lit(200)))
_add("t18_draft_checks", lambda p: _draft(p).select("post_id", *[f"k.{x}" for x in _FLAT], F.array_join("k.suggestions", ", ").alias("suggestions")), f"""WITH {_READ}, {_FEAT}, n AS (SELECT f.*, title_words AS t, body_words AS b, ease FROM f JOIN rd USING (post_id)),
s AS (SELECT post_id, t, b, CASE WHEN t BETWEEN 6 AND 14 THEN 100 WHEN abs(t - 6) <= 3 OR abs(t - 14) <= 3 THEN 70 ELSE 30 END AS title_length, CASE WHEN b = 0 OR b BETWEEN 50 AND 200 THEN 100 WHEN b < 50 THEN 50 ELSE 40 END AS body_length,
 CASE WHEN b < 20 OR ease BETWEEN 50 AND 85 THEN 100 WHEN ease BETWEEN 40 AND 90 THEN 70 ELSE 40 END AS readability, CASE WHEN body = '' THEN 80 ELSE {_presence("(title || ' ' || substring(body, 1, 200))")} END AS hook,
 list_filter([CASE WHEN t < 5 THEN 'short title' END, CASE WHEN t > 30 THEN 'long title' END, CASE WHEN length(trim(body)) < 10 THEN 'no body' END, CASE WHEN b < 50 AND {_GENERIC.replace("{0}", "(title || body)")} THEN 'generic' END], lambda x: x IS NOT NULL) AS bad FROM n)
SELECT post_id, title_length, body_length, readability, hook, greatest(0, 100 - 30 * len(bad)) AS anti, title_length > 30 AND len(bad) = 0 AS passed,
 array_to_string(list_concat(list_filter([CASE WHEN title_length < 100 THEN 'title length' END, CASE WHEN body_length < 100 THEN 'body length' END, CASE WHEN readability < 100 THEN 'readability' END, CASE WHEN hook < 50 THEN 'hook' END], lambda x: x IS NOT NULL), bad), ', ') AS suggestions FROM s""")
_rate = lambda p: p.withColumn("rate", F.when(c("num_comments") % 3 == 0, c("num_comments") * 5))
_TODO = "MAP {" + ", ".join(f"'{k}': {_q(v)}" for k, v in D.ACTIONS.items()) + "}"
_add("t20_failure_reasons", lambda p: _rounded(_rate(p).withColumn("k", D.attribution(c("title"), c("body"), c("upvote_ratio"), c("rate"))).select("post_id", F.coalesce("k.primary", F.lit("-")).alias("primary"), F.array_join("k.secondary", ", ").alias("secondary"), F.array_join("k.actions", ", ").alias("actions"), "k.confidence"), "confidence"), f"""WITH r AS (SELECT post_id, upvote_ratio AS u, {_TW} AS n, {_BW} AS m, CASE WHEN num_comments % 3 = 0 THEN num_comments * 5 END AS rate FROM posts),
s AS (SELECT *, CASE WHEN n < 5 THEN 20 WHEN n > 30 THEN 30 ELSE 70 END AS t, CASE WHEN m < 20 THEN 20 WHEN m > 1000 THEN 30 ELSE 70 END AS b, CASE WHEN u > 0 AND u < 0.5 THEN 20 WHEN u >= 0.7 THEN 75 ELSE 50 END AS q, CASE WHEN rate < 20 THEN 25 END AS p FROM r),
w AS (SELECT *, list_transform(list_sort(list_filter([CASE WHEN t < 50 THEN {{'s': t, 'i': 0, 'd': 'title'}} END, CASE WHEN b < 50 THEN {{'s': b, 'i': 1, 'd': 'body'}} END, CASE WHEN q < 50 THEN {{'s': q, 'i': 2, 'd': 'quality'}} END, CASE WHEN p < 50 THEN {{'s': p, 'i': 3, 'd': 'pattern'}} END], lambda x: x IS NOT NULL)), lambda x: x.d) AS d FROM s)
SELECT post_id, coalesce(d[1], '-') AS primary, array_to_string(d[2:3], ', ') AS secondary, CASE WHEN len(d) = 0 THEN 'take another pattern or community' ELSE array_to_string(list_transform(d[1:3], lambda k: {_TODO}[k]), ', ') END AS actions,
 round(least(90.0::DOUBLE, greatest(20.0::DOUBLE, 100 - (t + b + q + 120 + coalesce(p, 0))::DOUBLE / (5 + (p IS NOT NULL)::INT))), 9) AS confidence FROM w""")

# ---------------------------------------------------------------- answers of a model, composed from the posts' own fields
_MODES = list(V._MODES)
_answer = lambda p: F.concat(F.lit("Labels\n 1: "), F.upper("narrative"), F.lit(".\n2) "), F.regexp_extract("narrative", "^[a-z]+", 0), F.lit("\n3. "), "subreddit", F.lit("\n- none"))
_SQL_FIT = "coalesce(list_filter([" + ", ".join(map(_q, _MODES)) + "], lambda k: contains({0}, k) OR contains(k, {0}))[1], " + _q(_MODES[0]) + ")"
_add("t28_numbered_labels", lambda p: M.features(p).select("post_id", F.array_join(D.numbered_labels(_answer(p), _MODES), ",").alias("labels")), f"WITH {_FEAT}, a AS (SELECT post_id, narrative AS x, regexp_extract(narrative, '^[a-z]+') AS y, lower(subreddit) AS z FROM f) SELECT post_id, {_SQL_FIT.replace('{0}', 'x')} || ',' || {_SQL_FIT.replace('{0}', 'y')} || ',' || {_SQL_FIT.replace('{0}', 'z')} AS labels FROM a")


def _noisy():
    """A score as JSON: bare, fenced after other words, amid words, or missing."""
    score, kind = F.concat(F.lit('{"score": '), c("upvotes").cast("string"), F.lit("}")), c("upvotes") % 4
    fenced = F.concat(F.lit("Here:\n```json\n"), score, F.lit("\n```\nDone {"))
    return F.when(kind == 0, score).when(kind == 1, fenced).when(kind == 2, F.concat(F.lit("So "), score, F.lit(" it is."))).otherwise("none {")


_add("t29_answers_as_json", lambda p: p.select("post_id", F.coalesce(F.get_json_object(D.json_text(_noisy()), "$.score").cast("long"), F.lit(-1)).alias("score")), "SELECT post_id, CASE WHEN upvotes % 4 < 3 THEN upvotes ELSE -1 END AS score FROM posts")

# ---------------------------------------------------------------- matching
_K = ", ".join(f"pat.{x}" for x in _KEYS.split(", "))


def _mined(train: str, percentile: float) -> str:
    """CTEs up to pt: the significant patterns of the posts of `train`, with template and ranges."""
    q = ", ".join(f"floor(quantile_cont({x}, {p}) FILTER ({t} <> '')) AS {n}" for x, p, t, n in (("title_words", 0.25, "title", "t_lo"), ("title_words", 0.75, "title", "t_hi"), ("body_words", 0.25, "body", "b_lo"), ("body_words", 0.75, "body", "b_hi")))
    return f"""{_FEAT.replace("FROM posts", "FROM " + train)}, {_TH.format(percentile)}, {_CL}, {_CHI},
pat AS (SELECT {_KEYS} FROM y WHERE chi2 >= 3.841459 AND viral * an > av * n ORDER BY rate * ln(n) DESC, {_KEYS} LIMIT 8), {_TPL},
rg AS (SELECT {_KEYS}, {q} FROM f JOIN pat USING ({_KEYS}), th WHERE upvotes >= threshold GROUP BY ALL),
pt AS (SELECT {_K}, t_lo, t_hi, b_lo, b_hi, list_filter(string_split(coalesce(template, ''), '|'), lambda g: g <> '') AS grams FROM pat LEFT JOIN rg USING ({_KEYS}) LEFT JOIN tpl USING ({_KEYS}))"""


def _confused(name: str, test: str, by: str, threshold: str) -> str:
    """CTEs up to `name`: confusion of pt with the posts of `test`, whose score is compared with `threshold`."""
    hit = "len(list_filter(grams, lambda g: contains(lower(title), g)))"
    title = f"CASE WHEN {hit} > 0 THEN 0.4::DOUBLE + 0.6::DOUBLE * {hit} / greatest(len(grams), 1) ELSE 0.0::DOUBLE END"
    part = lambda test, w: f"CASE WHEN {test} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END"
    score = f"{part('e.hook = pt.hook', 0.2)} + {part('e.narrative = pt.narrative', 0.2)} + ({title}) * 0.35::DOUBLE + ({part('e.title_words BETWEEN t_lo AND t_hi', 0.125)} + {part('e.body_words BETWEEN b_lo AND b_hi', 0.125)})"
    keys = by and by + ", "
    return f"""{_FEAT.replace("f AS", name + "_f AS").replace("FROM posts", "FROM " + test)},
{name}_m AS (SELECT {keys}upvotes >= ({threshold}) AS a, EXISTS (SELECT 1 FROM pt WHERE {score} >= 0.45::DOUBLE) AS p FROM {name}_f e),
{name}_c AS (SELECT {keys}count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM {name}_m {"GROUP BY ALL" if by else ""}),
{name} AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM {name}_c)"""


_OWN = "SELECT quantile_cont(upvotes, 0.8) FROM {0}_f"
_AT = "created_utc {0} TIMESTAMP '2024-01-15'"
_BACK = f"WITH a0 AS (SELECT * FROM posts WHERE {_AT.format('<')}), b0 AS (SELECT * FROM posts WHERE {_AT.format('>=')}), {_mined('a0', 0.8)}, {_confused('t', 'b0', 'tier', _OWN.format('t'))} SELECT tier, tp, fp, fn, tn, precision, recall, f1 FROM t"
ORACLES["c3_backtest"] = f"WITH {S.POSTS_SQL}, {_BACK[5:]}"
_IN = "lower(subreddit) {0} (SELECT subreddit FROM ho)"
_RATIO = "holdout_precision / greatest(train_precision, 0.001::DOUBLE)"
_HELD = f"""WITH {_HO}, a0 AS (SELECT * FROM posts WHERE {_IN.format('NOT IN')}), b0 AS (SELECT * FROM posts WHERE {_IN.format('IN')}), {_mined('a0', 0.8)}, {_confused('t', 'a0', '', _OWN.format('t'))}, {_confused('h', 'b0', '', _OWN.format('h'))},
z AS (SELECT t.precision AS train_precision, t.recall AS train_recall, h.precision AS holdout_precision, h.recall AS holdout_recall FROM t, h)
SELECT *, {_RATIO} AS ratio, least({_RATIO}, 1.0) AS transfer, {_RATIO} >= 0.7 AS passed FROM z"""
ORACLES["c4_holdout"] = f"WITH {S.POSTS_SQL}, {_HELD[5:]}"
_MOVED = " UNION ALL ".join(
    f"SELECT * FROM (WITH a0 AS (SELECT * FROM posts WHERE tier = '{k}'), b0 AS (SELECT * FROM posts WHERE tier <> '{k}'), {_mined('a0', 0.8)}, {_confused('t', 'b0', 'tier', 'SELECT quantile_cont(upvotes, 0.8) FROM posts x WHERE x.tier = e.tier')} SELECT '{k}' AS source_tier, tier AS target_tier, tp, fp, fn, tn, precision, recall, f1 FROM t)"
    for k in ("t1", "t2", "t3")
)
ORACLES["a60_transfer_matrix"] = f"WITH {S.POSTS_SQL} {_MOVED}"


def _gate(tier: str) -> str:
    """A tier's row of the gate: backtest, and the holdout of its first two communities by hash."""
    back = f"WITH a0 AS (SELECT * FROM posts WHERE tier = '{tier}' AND {_AT.format('<')}), b0 AS (SELECT * FROM posts WHERE tier = '{tier}' AND {_AT.format('>=')}), {_mined('a0', 0.8)}, {_confused('t', 'b0', '', _OWN.format('t'))} SELECT precision, recall, f1 FROM t"
    ho = f"ho AS (SELECT s FROM (SELECT DISTINCT lower(subreddit) AS s FROM posts WHERE tier = '{tier}') ORDER BY md5(s || '-42'), s LIMIT 2)"
    inside = "lower(subreddit) {0} (SELECT s FROM ho)"
    held = f"WITH {ho}, a0 AS (SELECT * FROM posts WHERE tier = '{tier}' AND {inside.format('NOT IN')}), b0 AS (SELECT * FROM posts WHERE tier = '{tier}' AND {inside.format('IN')}), {_mined('a0', 0.8)}, {_confused('t', 'a0', '', _OWN.format('t'))}, {_confused('h', 'b0', '', _OWN.format('h'))} SELECT CASE WHEN (SELECT count(*) FROM a0) > 0 THEN t.precision END AS train_precision, CASE WHEN (SELECT count(*) FROM b0) > 0 THEN h.precision END AS holdout_precision FROM t, h"
    return f"SELECT '{tier}' AS tier, (SELECT count(*) FROM posts WHERE tier = '{tier}') AS n, * FROM ({back}), ({held})"


_add("c5_stratified", lambda p: V.stratified(p, "2024-01-15", n=2, least_posts=20), None)
ORACLES["c5_stratified"] = f"""WITH {S.POSTS_SQL}, g AS ({" UNION ALL ".join(_gate(k) for k in ("t1", "t2", "t3"))}), r AS (SELECT *, holdout_precision / greatest(train_precision, 0.001::DOUBLE) AS ratio FROM g WHERE n >= 20),
x AS (SELECT *, recall >= 0.4 AND precision >= 0.3 AS backtest_passed, coalesce(ratio >= 0.7, FALSE) AS holdout_passed FROM r) SELECT *, (SELECT bool_or(backtest_passed) AND bool_or(holdout_passed) FROM x) AS passed FROM x"""



def _details(p):
    f = V.prepared(p)
    out = M.detailed(f, written(M.over_represented(f, 0.8), "mined"), 0.8)
    return out.select(*_KEYS.split(", "), "viral", "n", F.coalesce("template", F.lit("")).alias("template"), "t_lo", "t_hi", "b_lo", "b_hi", F.array_join("exemplars", ",").alias("exemplars"), F.array_join("communities", ",").alias("communities"))


_add("a43_pattern_details", _details, f"""WITH {_mined("posts", 0.8).replace("pat AS (SELECT " + _KEYS + " FROM y", "pat AS (SELECT " + _KEYS + ", viral, n FROM y")},
ve AS (SELECT {_KEYS}, post_id, row_number() OVER (PARTITION BY {_KEYS} ORDER BY doc_id) AS i FROM f, th WHERE upvotes >= threshold), ex AS (SELECT {_KEYS}, string_agg(post_id, ',' ORDER BY i) FILTER (i <= 5) AS exemplars FROM ve GROUP BY ALL),
cm AS (SELECT {_KEYS}, string_agg(DISTINCT subreddit, ',' ORDER BY subreddit) AS communities FROM f GROUP BY ALL)
SELECT {_K}, viral, n, coalesce(template, '') AS template, t_lo::BIGINT AS t_lo, t_hi::BIGINT AS t_hi, b_lo::BIGINT AS b_lo, b_hi::BIGINT AS b_hi, exemplars, communities FROM pat LEFT JOIN rg USING ({_KEYS}) LEFT JOIN tpl USING ({_KEYS}) LEFT JOIN ex USING ({_KEYS}) LEFT JOIN cm USING ({_KEYS})""")

# ---------------------------------------------------------------- models
_add("l7_feature_importance", lambda p: V.importances(p, "2024-01-15"), None)
_add("m3_valence", lambda p: V.valence_scores(p, V.valence_lexicon(p)).withColumn("compound", F.round("compound", 9) + 0.0), """WITH w AS (SELECT post_id, upvotes, unnest(regexp_extract_all(lower(title), '[a-z]{3,}')) AS word FROM posts),
lx AS (SELECT word, round(avg(upvotes) / (SELECT avg(upvotes) FROM posts) - 1, 1) AS valence FROM (SELECT DISTINCT post_id, upvotes, word FROM w) GROUP BY word HAVING count(*) >= 20),
s AS (SELECT post_id, sum(valence) AS s FROM w JOIN lx USING (word) GROUP BY post_id)
SELECT post_id, round(coalesce(s / sqrt(s * s + 15), 0.0::DOUBLE), 9) + 0.0 AS compound FROM posts LEFT JOIN s USING (post_id)""")
