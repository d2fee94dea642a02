"""Queries of text scores, significance, selection and validation, with their SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractionlens.functions import text as T
from tractionlens.operators import analysis as A
from tractionlens.operators import feedback as B
from tractionlens.operators import mining as M
from tractionlens.operators import selection as R
from tractionlens.operators import validation as V
from tractionlens.plans.registry import _BW, _CL, _CLS, _FEAT, _N, _NARRATIVE, _NW, _P, _STRIP, _TH, _TW, ORACLES, QUERIES, _add, _add_f, _any, _classified, _hits, _q
from tractionlens.sources import posts as S

c = F.col
_STOP = ", ".join(map(_q, T.STOP_WORDS))


def _two_sided(z: str) -> str:
    series = "0.17087277"
    for k in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        series = f"({k}::DOUBLE + t * {series})"
    return f"(SELECT t * exp({series} - x * x) FROM (SELECT x, 1 / (1 + 0.5 * x) AS t FROM (SELECT abs({z}) / sqrt(2.0::DOUBLE) AS x)))"


def _correlation(x: str, y: str, by: str, source: str) -> str:
    """SQL of with_p(pearson()) over the rows of `source` (k, x, y)."""
    r = "CASE WHEN n < 10 OR vx <= 0 OR vy <= 0 THEN 0.0 ELSE cov::DOUBLE / (sqrt(vx::DOUBLE) * sqrt(vy::DOUBLE)) END"
    z = "sqrt((n - 2) * ln(1 + r * r * (n - 2) / greatest(1 - r * r, 1e-300) / (n - 2))) * (8 * (n - 2) + 1) / (8 * (n - 2) + 3)"
    return f"""s AS (SELECT {by} count(*) AS n, count(*) * sum({x} * {y}) - sum({x}) * sum({y}) AS cov, count(*) * sum({x} * {x}) - sum({x}) * sum({x}) AS vx, count(*) * sum({y} * {y}) - sum({y}) * sum({y}) AS vy FROM {source} GROUP BY ALL),
q AS (SELECT {by} n, {r} AS r FROM s), zz AS (SELECT *, {z} AS z FROM q) SELECT {by} n, round(r, 9) AS r, round(CASE WHEN n < 10 OR r = 0 THEN 1.0 ELSE {_two_sided("z")} END, 9) AS p FROM zz"""


def _rounded(df, *columns: str):
    return df.withColumns({x: F.round(x, 9) for x in columns})


# ---------------------------------------------------------------- significance
_add("a3_critical_gaps", lambda p: A.gaps(p, p.select("subreddit"), 240).where("n < 120").withColumn("critical", c("n") < 100), "SELECT subreddit, count(*) AS n, 240 - count(*) AS shortfall, count(*) < 100 AS critical FROM posts GROUP BY 1 HAVING count(*) < 120")
_add("a7_correlation_p", lambda p: _rounded(A.with_p(A.pearson(p.withColumn("w", T.n_words(c("body"))), "w", "upvotes", ["tier"])), "r", "p"), f"WITH w AS (SELECT tier, {_BW} AS x, upvotes AS y FROM posts), " + _correlation("x", "y", "tier,", "w"))
_add("a17_sentiment_correlation", lambda p: _rounded(A.with_p(A.pearson(p.withColumn("w", F.round(T.intensity(c("title")) * 10).cast("long")), "w", "upvotes", [])), "r", "p"), f"WITH w AS (SELECT round(CASE WHEN {_P} = {_N} THEN 0.3 ELSE least(greatest({_P}, {_N}) / 5, 1.0) END * 10)::BIGINT AS x, upvotes AS y FROM posts), " + _correlation("x", "y", "", "w"))
_ENGAGING = "(contains(last, '?') OR " + _any("last", T.ENGAGING) + ")"
_LAST = "e AS (SELECT *, trim(string_split(trim(body), '.')[-1]) AS last FROM posts)"
_add("a22_engagement_correlation", lambda p: _rounded(A.with_p(A.pearson(p.where(F.length("body") >= 20).withColumn("w", T.calls_to_answer(c("body")).cast("long")), "w", "num_comments", [])), "r", "p"), f"WITH w AS (SELECT (ends_with({_STRIP.format('body')}, '?') OR {_any('body', T.CALLS)})::BIGINT AS x, num_comments AS y FROM posts WHERE length(body) >= 20), " + _correlation("x", "y", "", "w"))
_add("t26_engaging", lambda p: p.select("post_id", T.engaging(c("body")).alias("engaging")), f"WITH {_LAST} SELECT post_id, {_ENGAGING} AS engaging FROM e")


def _chi_square(p):
    f = M.features(p).crossJoin(F.broadcast(M.viral_threshold(p, 0.9, [])))
    g = f.groupBy("hook").agg(F.count_if(c("upvotes") >= c("threshold")).alias("a"), F.count("*").alias("k"))
    g = g.crossJoin(F.broadcast(g.agg(F.sum("a").alias("av"), F.sum("k").alias("n"))))
    g = g.withColumn("chi2", M.chi_square(c("a"), c("k") - c("a"), c("av") - c("a"), c("n") - c("k") - c("av") + c("a")))
    v, pr = F.sqrt(c("chi2") / c("n")), F.when(c("chi2") <= 0, 1.0).otherwise(A.two_sided(F.sqrt("chi2")))
    return _rounded(g.select("hook", "n", "chi2", v.alias("v"), pr.alias("p")), "chi2", "v", "p")


_add("a8_chi_square", _chi_square, f"""WITH {_FEAT}, {_TH.format(0.9)}, g AS (SELECT hook, count(*) FILTER (upvotes >= threshold) AS a, count(*) AS k FROM f, th GROUP BY 1),
w AS (SELECT hook, a::DOUBLE AS a, (k - a)::DOUBLE AS b, (sum(a) OVER () - a)::DOUBLE AS c, (sum(k) OVER () - k - sum(a) OVER () + a)::DOUBLE AS d, (sum(k) OVER ())::BIGINT AS n FROM g),
x AS (SELECT hook, n, CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) <= 0 THEN 0.0 ELSE n::DOUBLE * power(greatest(abs(a * d - b * c) - n::DOUBLE / 2, 0.0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) END AS chi2 FROM w),
z AS (SELECT *, sqrt(chi2) AS z FROM x)
SELECT hook, n, round(chi2, 9) AS chi2, round(sqrt(chi2 / n), 9) AS v, round(CASE WHEN chi2 <= 0 THEN 1.0 ELSE {_two_sided("z")} END, 9) AS p FROM z""")


def _association(p):
    """Chi-square of media by tier, any number of rows and columns: n * (sum of o^2 / (row * column) - 1), and Cramer's V."""
    cells = p.groupBy("tier", "content_type").agg(F.count("*").alias("o"))
    rows, cols = (cells.groupBy(k).agg(F.sum("o").alias(n)) for k, n in (("tier", "r"), ("content_type", "k")))
    whole = cells.agg(F.sum("o").alias("n"), F.count_distinct("tier").alias("rows"), F.count_distinct("content_type").alias("columns"))
    s = cells.join(F.broadcast(rows), "tier").join(F.broadcast(cols), "content_type").crossJoin(F.broadcast(whole)).groupBy("n", "rows", "columns")
    s = s.agg(F.sum(c("o").cast("double") * c("o") / (c("r").cast("double") * c("k"))).alias("s")).withColumn("chi2", c("n") * (c("s") - 1))
    return _rounded(s.select("n", ((c("rows") - 1) * (c("columns") - 1)).alias("dof"), "chi2", F.sqrt(c("chi2") / (c("n") * F.least(c("rows") - 1, c("columns") - 1))).alias("v")), "chi2", "v")


_add("a8_association", _association, """WITH o AS (SELECT tier, content_type, count(*) AS o FROM posts GROUP BY ALL),
s AS (SELECT *, sum(o) OVER (PARTITION BY tier) AS r, sum(o) OVER (PARTITION BY content_type) AS k, sum(o) OVER () AS n FROM o),
t AS (SELECT n::BIGINT AS n, count(DISTINCT tier) AS a, count(DISTINCT content_type) AS b, n * (sum(o::DOUBLE * o / (r::DOUBLE * k)) - 1) AS chi2 FROM s GROUP BY n)
SELECT n, (a - 1) * (b - 1) AS dof, round(chi2, 9) AS chi2, round(sqrt(chi2 / (n * least(a - 1, b - 1))), 9) AS v FROM t""")


def _bootstrap(p, draws: int = 200):
    """Mean score by tier with the 95 % interval of a Poisson bootstrap: a row's weight in a draw follows from a hash."""
    u = F.conv(F.substring(F.md5(F.concat_ws("-", "post_id", "draw").cast("binary")), 1, 4), 16, 10).cast("int")
    weight = F.when(u < 24109, 0).when(u < 48218, 1).when(u < 60272, 2).when(u < 64290, 3).when(u < 65294, 4).otherwise(5)
    d = p.select("tier", "post_id", "upvotes", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("w", weight)
    d = d.groupBy("tier", "draw").agg((F.sum(c("w") * c("upvotes")).cast("double") / F.sum("w")).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    means = p.groupBy("tier").agg(F.avg("upvotes").alias("mean"))
    return _rounded(means.join(d.groupBy("tier").agg(q.alias("q")), "tier").select("tier", "mean", c("q")[0].alias("lower"), c("q")[1].alias("upper")), "mean", "lower", "upper")


_add("a9_bootstrap_mean", _bootstrap, """WITH d AS (SELECT tier, upvotes, draw, ('0x' || substring(md5(post_id || '-' || draw), 1, 4))::INT AS u FROM posts, (SELECT unnest(range(1, 201)) AS draw)),
w AS (SELECT *, CASE WHEN u < 24109 THEN 0 WHEN u < 48218 THEN 1 WHEN u < 60272 THEN 2 WHEN u < 64290 THEN 3 WHEN u < 65294 THEN 4 ELSE 5 END AS w FROM d),
m AS (SELECT tier, draw, sum(w * upvotes)::DOUBLE / sum(w) AS m FROM w GROUP BY ALL), q AS (SELECT tier, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM m GROUP BY 1)
SELECT tier, round(mean, 9) AS mean, round(lower, 9) AS lower, round(upper, 9) AS upper FROM q JOIN (SELECT tier, avg(upvotes) AS mean FROM posts GROUP BY 1) USING (tier)""")


def _wilson(p):
    g = M.clusters(M.features(p)).where("n >= 10")
    n, r, z = c("n").cast("double"), c("rate"), 1.959963984540054
    middle, half = (r + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(r * (1 - r) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    bounds = [(F.round(x, 9) + 0.0).alias(k) for k, x in (("lower", middle - half), ("upper", middle + half))]  # no negative zero
    return g.select("tier", "hook", "narrative", "content_type", "n", *bounds)


_Z = "1.959963984540054::DOUBLE"
_HALF = f"{_Z} * sqrt(rate * (1 - rate) / n::DOUBLE + {_Z} * {_Z} / (4 * n::DOUBLE * n)) / (1 + {_Z} * {_Z} / n)"
_MID = f"(rate + {_Z} * {_Z} / (2 * n::DOUBLE)) / (1 + {_Z} * {_Z} / n)"
_add("a44_rate_intervals", _wilson, f"WITH {_FEAT}, {_TH.format(0.9)}, {_CL} SELECT tier, hook, narrative, content_type, n, round({_MID} - {_HALF}, 9) + 0.0 AS lower, round({_MID} + {_HALF}, 9) + 0.0 AS upper FROM cl WHERE n >= 10")

# ---------------------------------------------------------------- text scores
_READ = r"""w AS (SELECT post_id, tier, upvotes, list_transform(regexp_extract_all(lower(body), '[^\s]+'), lambda x: trim(x, '.:;?!')) AS ws, len(list_filter(regexp_split_to_array(body, '[.!?]+'), lambda x: trim(x) <> '')) AS sentences FROM posts),
y AS (SELECT *, len(ws) AS n, coalesce(list_sum(list_transform(ws, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - ends_with(x, 'e')::INT))), 0) AS syl FROM w),
rd AS (SELECT post_id, tier, upvotes, CASE WHEN n > 0 AND sentences > 0 THEN greatest(0.0, 0.39::DOUBLE * (n / sentences) + 11.8::DOUBLE * (syl / n) - 15.59::DOUBLE) ELSE 0.0 END AS grade,
  CASE WHEN n > 0 AND sentences > 0 THEN greatest(0.0, least(100.0, 206.835::DOUBLE - 1.015::DOUBLE * (n / sentences) - 84.6::DOUBLE * (syl / n))) ELSE 0.0 END AS ease FROM y)"""
_read = lambda p: p.withColumn("r", T.readability(c("body")))
_add("t3_readability", lambda p: _rounded(_read(p).select("post_id", "r.*"), "grade", "ease"), f"WITH {_READ} SELECT post_id, round(grade, 9) AS grade, round(ease, 9) AS ease FROM rd")
_graded = lambda p: _read(p.where(F.length("body") >= 20)).withColumn("e", F.round(c("r.grade") * 100).cast("long"))
_GRADED = f"{_READ}, gr AS (SELECT post_id, tier, upvotes, round(grade * 100)::BIGINT AS e FROM rd JOIN posts USING (post_id, tier, upvotes) WHERE length(body) >= 20)"
_add("a23_readability_range", lambda p: A.optimal_range(_graded(p), "e", "upvotes", ["tier"]), f"""WITH {_GRADED}, r AS (SELECT tier, e AS m, post_id, upvotes AS u FROM gr),
k AS (SELECT *, row_number() OVER w AS i, sum(u) OVER (PARTITION BY tier ORDER BY m, post_id ROWS UNBOUNDED PRECEDING) AS c, count(*) OVER (PARTITION BY tier) AS n FROM r WINDOW w AS (PARTITION BY tier ORDER BY m, post_id)),
b AS (SELECT a.tier, a.i, a.m, z.m AS hi, z.c - (a.c - a.u) AS s FROM k a JOIN k z ON a.tier = z.tier AND z.i = a.i + greatest(5, a.n // 5) - 1 WHERE a.i <= a.n - greatest(5, a.n // 5)),
t AS (SELECT * FROM b WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY tier ORDER BY s DESC, i) = 1) SELECT tier, m AS low, hi AS high FROM t""")
_add("a23_readability_correlation", lambda p: _rounded(A.with_p(A.pearson(_graded(p), "e", "upvotes", ["tier"])), "r", "p"), f"WITH {_GRADED}, z AS (SELECT tier, e AS x, upvotes AS y FROM gr), " + _correlation("x", "y", "tier,", "z"))
_PAR = r"CASE WHEN trim(body) = '' THEN 0 ELSE len(regexp_extract_all(body, '\n\n')) + 1 END"
_add("t4_paragraphs", lambda p: p.select("post_id", T.paragraphs(c("body")).alias("paragraphs")), f"SELECT post_id, ({_PAR})::BIGINT AS paragraphs FROM posts")
_DIST = "SELECT tier, count(*) AS n, avg(x) AS mean, sqrt((count(*)::DOUBLE * sum(x*x)::DOUBLE - sum(x)::DOUBLE * sum(x)::DOUBLE) / (count(*)::DOUBLE * count(*)::DOUBLE)) AS std, " + ", ".join(f"quantile_cont(x, {q / 100}) AS p{q}" for q in (10, 25, 50, 75, 90, 95, 99)) + " FROM w GROUP BY tier"
_add("a23_grade_distribution", lambda p: A.distribution(_graded(p), "e", ["tier"]), f"WITH {_GRADED}, z AS (SELECT tier, e AS x FROM gr) {_DIST.replace('FROM w', 'FROM z')}")
_add("a23_paragraph_distribution", lambda p: A.distribution(p.where(F.length("body") >= 20).withColumn("x", (F.regexp_count("body", F.lit("\n\n")) + 1).cast("long")), "x", ["tier"]), rf"WITH w AS (SELECT tier, (len(regexp_extract_all(body, '\n\n')) + 1)::BIGINT AS x FROM posts WHERE length(body) >= 20) {_DIST}")
_MEDIA = "CASE trim(lower(a)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.MEDIA_ALIASES.items()) + " ELSE 'text' END"
_add("t5_media_aliases", lambda p: p.withColumn("a", F.concat(F.lit(" "), F.upper("content_type"))).groupBy(T.media(c("a")).alias("media")).agg(F.count("*").alias("n")), f"SELECT {_MEDIA} AS media, count(*) AS n FROM (SELECT ' ' || upper(content_type) AS a FROM posts) GROUP BY 1")
_add("t6_tier_of_size", lambda p: p.groupBy("subreddit").agg((F.sum("upvotes") * 20_000).alias("size")).withColumn("tier", T.tier_of(c("size"))), "SELECT subreddit, (sum(upvotes) * 20000)::BIGINT AS size, CASE WHEN sum(upvotes) * 20000 >= 20000000 THEN 't1' WHEN sum(upvotes) * 20000 >= 1000000 THEN 't2' ELSE 't3' END AS tier FROM posts GROUP BY 1")
_add("t9_sentiment", lambda p: p.select("post_id", T.polarity(c("title")).alias("polarity"), T.intensity(c("title")).alias("intensity")), f"SELECT post_id, CASE WHEN {_P} > {_N} THEN 'positive' WHEN {_N} > {_P} THEN 'negative' ELSE 'neutral' END AS polarity, (CASE WHEN {_P} = {_N} THEN 0.3 ELSE least(greatest({_P}, {_N}) / 5, 1.0) END)::DOUBLE AS intensity FROM posts")
_OPEN = "CASE WHEN ends_with(s, '?') THEN 'rhetorical_question' " + " ".join(f"WHEN {_any('s', v)} THEN '{k}'" for k, v in T.OPENINGS.items()) + " ELSE 'background_first' END"
_add("t10_openings", lambda p: p.groupBy(T.opening(c("body")).alias("opening")).agg(F.count("*").alias("n"), F.sum("upvotes").alias("total")), f"SELECT {_OPEN} AS opening, count(*) AS n, sum(upvotes)::BIGINT AS total FROM (SELECT upvotes, lower(string_split(substring(body, 1, 200), '.')[1]) AS s FROM posts) GROUP BY 1")
_PI = "2 * 3.141592653589793::DOUBLE"
_add("t13_cycles", lambda p: p.select("post_id", *[F.round(f(2 * 3.141592653589793 * x / n), 9).alias(k) for k, f, x, n in (("hour_sin", F.sin, F.coalesce(F.hour("created_utc"), F.lit(12)), 24), ("day_cos", F.cos, F.coalesce(F.weekday("created_utc"), F.lit(3)), 7))], (F.coalesce(F.weekday("created_utc"), F.lit(3)) >= 5).alias("weekend")), f"SELECT post_id, round(sin({_PI} * coalesce(hour(created_utc), 12) / 24), 9) AS hour_sin, round(cos({_PI} * coalesce(isodow(created_utc) - 1, 3) / 7), 9) AS day_cos, coalesce(isodow(created_utc) - 1, 3) >= 5 AS weekend FROM posts")
_FIT = f"CASE WHEN {_TW} BETWEEN 8 AND 22 THEN 30 WHEN abs({_TW} - 8) <= 3 OR abs({_TW} - 22) <= 3 THEN 15 ELSE 0 END"
_add("t17_title_scores", lambda p: p.select("post_id", T.title_score(c("title"), F.lit(8), F.lit(22)).alias("score")), rf"""SELECT post_id, least(100, greatest(0, 50 + {_FIT} - {_hits('title', T.CLICKBAIT)} * 10 - CASE WHEN len(regexp_extract_all(title, '!')) > 1 THEN 5 ELSE 0 END - CASE WHEN len(regexp_extract_all(title, '\?')) > 1 THEN 3 ELSE 0 END
  + CASE WHEN regexp_matches(title, '^\p{{Lu}}') THEN 10 ELSE 0 END - CASE WHEN {_TW} < 3 THEN 20 WHEN {_TW} > 50 THEN 15 ELSE 0 END))::BIGINT AS score FROM posts""")
_TOK = "SELECT {0} AS id, regexp_extract_all(lower({1}), '[a-z]{{3,}}') AS w FROM {2}"
_TOKENS = "list_sort(list_distinct(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || w[i + 1]))))"
_add("t22_tokens", lambda p: p.select("post_id", F.array_join(T.tokens(c("title")), " ").alias("tokens")), f"WITH t AS ({_TOK.format('post_id', 'title', 'posts')}) SELECT id AS post_id, array_to_string({_TOKENS}, ' ') AS tokens FROM t")
_add("t23_request_words", lambda p: p.select("post_id", F.array_join(T.request_words(c("title")), " ").alias("words")), rf"SELECT post_id, array_to_string(list_concat(regexp_extract_all(title, '[\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}]{{2,}}'), list_filter(regexp_extract_all(lower(title), '[a-z]{{3,}}'), lambda x: x NOT IN ({_STOP})))[1:15], ' ') AS words FROM posts")
_FLAIR = "CASE " + " ".join(f"WHEN {_any('body', v)} THEN '{k}'" for k, v in T.FLAIRS.items()) + " END"
_add("t25_flair", lambda p: p.groupBy(T.flair(c("body")).alias("flair")).agg(F.count("*").alias("n")), f"SELECT {_FLAIR} AS flair, count(*) AS n FROM posts GROUP BY 1")
_add("a35_image_titles", lambda p: A.image_titles(p), f"""WITH i AS (SELECT * FROM posts WHERE content_type = 'image') SELECT count(*) AS n, avg({_TW}) AS title_words, (count(*) FILTER (regexp_matches(title, '[0-9]')))::DOUBLE / count(*) AS number_rate,
 (count(*) FILTER (ends_with(trim(title), '?')))::DOUBLE / count(*) AS question_rate, avg(upvotes) AS avg_upvotes, (count(*) FILTER (upvotes >= (SELECT avg(upvotes) FROM posts)))::DOUBLE / count(*) AS above_mean FROM i""")

# ---------------------------------------------------------------- templates, patterns by tier, reports
_KEYS = "tier, hook, narrative, content_type"


def _viral(p):
    f = M.features(p)
    return f.crossJoin(F.broadcast(M.viral_threshold(f, 0.8, []))).where(c("upvotes") >= c("threshold"))


_MSTOP = ", ".join(map(_q, M.STOP))
#: CTEs from f and th to tpl: the title template of each cluster of viral posts.
_TPL = rf"""v AS (SELECT * FROM f, th WHERE upvotes >= threshold AND title <> ''),
w AS (SELECT {_KEYS}, list_filter(list_transform(string_split(trim(regexp_replace(title, '\s+', ' ', 'g')), ' '), lambda x: trim(lower(x), '.,!?:;"''()[]')), lambda x: x NOT IN ({_MSTOP}) AND length(x) > 2) AS w FROM v),
e AS (SELECT {_KEYS}, count(*) AS titles FROM w GROUP BY ALL HAVING count(*) >= 3), g AS (SELECT {_KEYS}, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w),
k AS (SELECT {_KEYS}, gram, count(*) AS k FROM g GROUP BY ALL), r AS (SELECT k.*, titles, row_number() OVER (PARTITION BY {", ".join("k." + x for x in _KEYS.split(", "))} ORDER BY k DESC, gram) AS r FROM k JOIN e USING ({_KEYS})),
u AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY r) AS q FROM r WHERE r <= 10 AND k >= greatest(2, floor(titles * 0.15))),
tpl AS (SELECT {_KEYS}, string_agg(gram, '|' ORDER BY r) AS template FROM u WHERE q <= 5 GROUP BY ALL)"""
_add("a45_title_templates", lambda p: M.templates(_viral(p), _KEYS.split(", ")), f"WITH {_FEAT}, {_TH.format(0.8)}, {_TPL} SELECT {_KEYS}, template FROM tpl")
_BY_TIER = f"""{_FEAT}, th AS (SELECT tier, quantile_cont(upvotes, 0.8) AS threshold FROM f GROUP BY 1), g AS (SELECT tier, hook, narrative, content_type, count(*) FILTER (upvotes >= threshold) AS viral, count(*) AS n FROM f JOIN th USING (tier) GROUP BY ALL),
w AS (SELECT *, (sum(viral) OVER t)::BIGINT AS av, (sum(n) OVER t)::BIGINT AS an FROM g WINDOW t AS (PARTITION BY tier)),
x AS (SELECT *, viral::DOUBLE AS a, (n - viral)::DOUBLE AS b, (av - viral)::DOUBLE AS c, (an - n - av + viral)::DOUBLE AS d FROM w WHERE n >= 10 AND viral >= 5),
y AS (SELECT *, CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) <= 0 THEN 0.0 ELSE an::DOUBLE * power(greatest(abs(a * d - b * c) - an::DOUBLE / 2, 0.0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) END AS chi2, viral::DOUBLE / n AS rate FROM x),
bt AS (SELECT tier, hook, narrative, content_type, viral, n, rate, round(chi2, 9) AS chi2, row_number() OVER (PARTITION BY tier ORDER BY round(rate * ln(n), 9) DESC, hook, narrative, content_type)::INT AS rank FROM y WHERE chi2 >= 2.705543 AND viral * an > av * n QUALIFY rank <= 8)"""
_by_tier = lambda p: V.patterns_by_tier(M.features(p), 0.8, critical=2.705543)
_add("a46_patterns_by_tier", lambda p: _rounded(_by_tier(p), "chi2"), f"WITH {_BY_TIER} SELECT * FROM bt")
_add("a61_universal_patterns", lambda p: V.universal(_by_tier(p)), f"WITH {_BY_TIER} SELECT hook, narrative, content_type, count(DISTINCT tier) AS tiers, min(tier) AS first_tier, CASE WHEN count(DISTINCT tier) >= 3 THEN 'universal' WHEN count(DISTINCT tier) = 1 THEN 'specific' ELSE 'shared' END AS kind FROM bt GROUP BY ALL")
_add("a56_profiles", lambda p: A.community_profiles(p), f"""WITH w AS (SELECT *, {_TW} AS tw, row_number() OVER (PARTITION BY subreddit ORDER BY upvotes) AS up, row_number() OVER (PARTITION BY subreddit ORDER BY upvotes DESC) AS down, count(*) OVER (PARTITION BY subreddit) AS k FROM posts),
m AS (SELECT subreddit, content_type, count(*) AS n FROM posts GROUP BY subreddit, content_type QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY count(*) DESC, content_type DESC) = 1)
SELECT w.subreddit, count(*) AS n, max(upvotes) FILTER (up = k // 2 + 1) AS median, max(upvotes) FILTER (down = k // 10 + 1) AS top_line, avg(tw) FILTER (title <> '') AS title_words, any_value(m.content_type) AS dominant, any_value(m.n)::DOUBLE / count(*) AS share
FROM w JOIN m USING (subreddit) GROUP BY w.subreddit HAVING count(*) >= 20""")
_add("a57_index", lambda p: A.counts(p, ["subreddit", "tier"]).union(p.agg(F.lit("all"), F.lit("all"), F.count("*"))), "SELECT 'subreddit' AS dimension, subreddit AS value, count(*) AS n FROM posts GROUP BY ALL UNION ALL SELECT 'tier', tier, count(*) FROM posts GROUP BY ALL UNION ALL SELECT 'all', 'all', count(*) FROM posts")
_add("a58_hook_table", lambda p: A.class_stats(p, T.hook_type(c("title")), "hook", []).orderBy(F.desc("avg_upvotes"), "hook").select("hook", "n", "avg_upvotes"), f"WITH {_FEAT} SELECT hook, count(*) AS n, avg(upvotes) AS avg_upvotes FROM f GROUP BY 1")

# ---------------------------------------------------------------- joins, sets and history
_add("j2_tier_of_community", lambda p: p.select("post_id", F.upper("subreddit").alias("s")).join(F.broadcast(p.where("tier <> 't2'").groupBy(F.lower("subreddit").alias("k")).agg(F.min("tier").alias("tier"))), F.lower("s") == c("k"), "left").select("post_id", "tier"), "SELECT post_id, CASE WHEN tier <> 't2' THEN tier END AS tier FROM posts")
_add_f("j6_feedback_patterns", lambda f: f.join(F.broadcast(f.groupBy("pattern_id").agg(F.count("*").alias("all_n")).where("pattern_id <> 'pattern_3'")), "pattern_id", "left").select("event_id", "pattern_id", F.coalesce("all_n", F.lit(0)).alias("all_n")), "SELECT event_id, pattern_id, CASE WHEN pattern_id <> 'pattern_3' THEN count(*) OVER (PARTITION BY pattern_id) ELSE 0 END AS all_n FROM feedback")


def _history(spark, d):
    f = _classified(S.feedback(spark, d))
    ids = S.events_by_post(spark, d).where(c("event_type") != "click").select("event_id", "doc_id")
    return R.history(S.posts(spark, d).select("doc_id", "subreddit"), f.join(ids, "event_id"))


_HIST = f"{_CLS}, h AS (SELECT ev.doc_id, fb.performance FROM fb JOIN ev USING (event_id) WHERE ev.event_type <> 'click' QUALIFY row_number() OVER (PARTITION BY ev.doc_id ORDER BY fb.tracked_at DESC, fb.event_id DESC) = 1), hist AS (SELECT p.doc_id, p.subreddit, coalesce(h.performance, '-') AS performance FROM posts p LEFT JOIN h USING (doc_id))"
QUERIES["j7_last_feedback"] = _history
ORACLES["j7_last_feedback"] = f"WITH {S.FEEDBACK_SQL}, {_HIST} SELECT * FROM hist"
QUERIES["f11_history_filter"] = lambda spark, d: _history(spark, d).where(c("subreddit").isin("src1", "src2", "src5") & (c("performance") == "failed"))
ORACLES["f11_history_filter"] = f"WITH {S.FEEDBACK_SQL}, {_HIST} SELECT * FROM hist WHERE subreddit IN ('src1', 'src2', 'src5') AND performance = 'failed'"
_add("u2_union_of_ids", lambda p: p.where("upvotes > 50").select("post_id").union(p.where("num_comments > 2").select("post_id")).distinct(), "SELECT post_id FROM posts WHERE upvotes > 50 UNION SELECT post_id FROM posts WHERE num_comments > 2")
_add("u3_missing_communities", lambda p: p.select("subreddit").distinct().join(p.where("upvotes > 1000").select("subreddit").distinct(), "subreddit", "left_anti"), "SELECT DISTINCT subreddit FROM posts EXCEPT SELECT subreddit FROM posts WHERE upvotes > 1000")
_add("w10_rank_of_communities", lambda p: A.top_per(p.groupBy("tier", "subreddit").agg(F.sum("upvotes").alias("total")), "tier", [F.desc("total"), "subreddit"], 5), "SELECT tier, subreddit, sum(upvotes)::BIGINT AS total, row_number() OVER (PARTITION BY tier ORDER BY sum(upvotes) DESC, subreddit)::INT AS rank FROM posts GROUP BY tier, subreddit QUALIFY rank <= 5")

# ---------------------------------------------------------------- requests
_INDEX = f"wk AS (SELECT subreddit, unnest(regexp_extract_all(lower(title), '[a-z]{{3,}}')) AS word FROM posts), ix AS (SELECT subreddit, word, count(*) AS n, row_number() OVER (PARTITION BY subreddit ORDER BY count(*) DESC, word)::INT AS rank FROM wk WHERE word NOT IN ({_STOP}) GROUP BY subreddit, word HAVING count(*) >= 3 QUALIFY rank <= 30)"
_add("c10_keyword_index", lambda p: R.keyword_index(p), f"WITH {_INDEX} SELECT subreddit, word, n, rank FROM ix")


def _requests(spark, d):
    """User turns are the requests."""
    t = S.table(spark, d, "conversations").where("role = 'user'")
    return t.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.coalesce("text", F.lit("")).alias("text"))


def _hints(p):
    """Words of one community only are hints for it."""
    ix = R.keyword_index(p)
    return ix.groupBy("word").agg(F.count("*").alias("k"), F.min("subreddit").alias("subreddit")).where("k = 1").select("word", "subreddit")


def _matched(spark, d):
    p = S.posts(spark, d)
    return R.communities_for(_requests(spark, d), R.keyword_index(p), _hints(p))


_RQ = f"rq AS ({_TOK.format('conv_id || ' + _q('-') + ' || turn', 'coalesce(text, ' + _q('') + ')', 'conversations WHERE role = ' + _q('user'))}), tk AS (SELECT id AS request_id, unnest({_TOKENS}) AS word FROM rq)"
_MT = f"""{_INDEX}, {_RQ}, hn AS (SELECT word, min(subreddit) AS subreddit, 2 AS weight FROM ix GROUP BY 1 HAVING count(*) = 1 UNION ALL SELECT word, subreddit, 1 FROM ix),
rawhits AS (SELECT request_id, subreddit, sum(weight) AS raw FROM tk JOIN hn USING (word) GROUP BY ALL UNION ALL SELECT request_id, s.subreddit, 5 FROM tk JOIN (SELECT DISTINCT subreddit FROM ix) s ON word = lower(s.subreddit)),
mt AS (SELECT request_id, subreddit, least(max(raw) / 5, 1.0)::DOUBLE AS score, row_number() OVER (PARTITION BY request_id ORDER BY least(max(raw) / 5, 1.0) DESC, subreddit)::INT AS rank FROM rawhits GROUP BY request_id, subreddit QUALIFY rank <= 3)"""
QUERIES["j13_communities_for_requests"] = _matched
ORACLES["j13_communities_for_requests"] = f"WITH {S.POSTS_SQL}, {_MT} SELECT * FROM mt"


def _patterns(p, live):
    """Clusters of at least 10 posts as patterns, with the live success rate of the pattern of their rank."""
    g = M.clusters(M.features(p)).where("n >= 10").withColumn("rate", F.round("rate", 9))
    g = g.orderBy(F.desc("rate"), F.desc("n"), "tier", "hook", "narrative", "content_type").limit(8)
    order = F.array_sort(F.collect_list(F.struct((-c("rate")).alias("a"), (-c("n")).alias("b"), "tier", "hook", "narrative", "content_type", "rate", "n")))
    g = g.agg(order.alias("x")).select(F.posexplode("x").alias("i", "x")).select(F.concat(F.lit("pattern_"), c("i").cast("string")).alias("pattern_id"), "x.tier", "x.hook", "x.narrative", "x.content_type", "x.rate", "x.n")
    return g.join(F.broadcast(live.select("pattern_id", F.round("success_rate", 9).alias("live"))), "pattern_id", "left")


_PT = f"""{_FEAT}, {_TH.format(0.9)}, {_CL}, lv AS (SELECT pattern_id, round((count(*) FILTER (performance <> 'failed'))::DOUBLE / count(*), 9) AS live FROM fb GROUP BY 1),
pt AS (SELECT 'pattern_' || (row_number() OVER (ORDER BY round(rate, 9) DESC, n DESC, tier, hook, narrative, content_type) - 1) AS pattern_id, tier, hook, narrative, content_type, round(rate, 9) AS rate, n FROM cl WHERE n >= 10 QUALIFY row_number() OVER (ORDER BY round(rate, 9) DESC, n DESC, tier, hook, narrative, content_type) <= 8),
pl AS (SELECT * FROM pt LEFT JOIN lv USING (pattern_id))"""


def _pattern_table(spark, d):
    return _patterns(S.posts(spark, d), B.success_rates(_classified(S.feedback(spark, d)), gate=1))


QUERIES["l5_generic_patterns"] = lambda spark, d: R.generic_patterns(_pattern_table(spark, d), 3).select("pattern_id", "hook", "rate", "n", "live")
ORACLES["l5_generic_patterns"] = f"WITH {S.FEEDBACK_SQL}, {_CLS}, {_PT} SELECT pattern_id, hook, rate, n, live FROM pl ORDER BY rate DESC, n DESC, pattern_id LIMIT 3"


def _selected(spark, d):
    p = S.posts(spark, d)
    requests = p.select(c("post_id").alias("request_id"), "tier", T.request_words(c("title")).alias("words"))
    return R.select_patterns(requests, _pattern_table(spark, d))


_WORDS = f"list_filter(regexp_extract_all(lower(title), '[a-z]{{3,}}'), lambda x: x NOT IN ({_STOP}))"
_TOPIC = "(" + " OR ".join(f"(hook = '{k}' AND {_any('joined', v)})" for k, v in T.HOOK_TOPICS.items()) + ")"
QUERIES["w7_pattern_selection"] = _selected
ORACLES["w7_pattern_selection"] = rf"""WITH {S.FEEDBACK_SQL}, {_CLS}, {_PT},
han AS (SELECT post_id AS request_id, tier AS rtier, list_concat(regexp_extract_all(title, '[\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}]{{2,}}'), {_WORDS})[1:15] AS words FROM posts),
rr AS (SELECT *, array_to_string(words, ' ') AS joined FROM han),
sc AS (SELECT request_id, pattern_id, hook, round(CASE WHEN tier = rtier THEN 40 ELSE 10 END + least(CASE WHEN live IS NOT NULL THEN 0.7::DOUBLE * rate + 0.3::DOUBLE * live ELSE rate END * 40, 30.0) + CASE WHEN n >= 100 THEN 15 WHEN n >= 30 THEN 8 ELSE 3 END
  + CASE WHEN len(words) = 0 THEN 0 WHEN len(list_filter(words, lambda w: contains(hook, lower(w)))) > 0 THEN 15 WHEN {_TOPIC} THEN 8 ELSE 0 END, 9) AS score FROM rr, pl),
b1 AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY request_id, hook ORDER BY score DESC, pattern_id) = 1)
SELECT request_id, pattern_id, hook, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pattern_id)::INT AS rank FROM b1 QUALIFY rank <= 3"""


def _predicted(f):
    users = f.select("user_id", "subreddit").distinct()
    out = R.predictions(users.crossJoin(F.broadcast(f.select("pattern_id").distinct())), f)
    return out.withColumns({k: F.coalesce(k, F.lit(-1)) for k in ("low", "high")})  # -1: no range


_add_f("a54_predictions", _predicted, """WITH h AS (SELECT user_id, subreddit, coalesce(pattern_id, 'unknown') AS pattern_id, actual_upvotes AS u FROM feedback WHERE actual_upvotes > 0),
w AS (SELECT user_id, subreddit, count(*) AS an, sum(u)::DOUBLE / count(*) AS a, max(u) AS top FROM h GROUP BY ALL),
o AS (SELECT h.user_id, h.subreddit, pattern_id, count(*) AS n, sum(u)::DOUBLE AS s, count(*) FILTER (u > a) AS ab FROM h JOIN w USING (user_id, subreddit) GROUP BY ALL),
k AS (SELECT user_id, subreddit, p.pattern_id FROM (SELECT DISTINCT user_id, subreddit FROM feedback) x, (SELECT DISTINCT pattern_id FROM feedback) p),
j AS (SELECT k.*, an, a, top, coalesce(n, 0) AS n, CASE WHEN coalesce(an, 0) < 3 THEN 50 WHEN coalesce(n, 0) = 0 THEN 40 ELSE least(95, greatest(5, floor(s / n / greatest(a, 1.0) * 60 + ab::DOUBLE / n * 30))) END::BIGINT AS score FROM k LEFT JOIN w USING (user_id, subreddit) LEFT JOIN o USING (user_id, subreddit, pattern_id))
SELECT user_id, subreddit, pattern_id, n, score, CASE WHEN an >= 3 THEN floor(CASE WHEN score >= 80 THEN top * 0.6::DOUBLE WHEN score >= 60 THEN a * 0.8::DOUBLE WHEN score >= 40 THEN a * 0.4::DOUBLE ELSE 0.0 END)::BIGINT ELSE -1 END AS low,
 CASE WHEN an >= 3 THEN floor(CASE WHEN score >= 80 THEN top * 1.2::DOUBLE WHEN score >= 60 THEN a * 1.5::DOUBLE WHEN score >= 40 THEN a ELSE a * 0.4::DOUBLE END)::BIGINT ELSE -1 END AS high,
 CASE WHEN coalesce(an, 0) < 3 THEN 'low' WHEN n >= 10 THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM j""")

# ---------------------------------------------------------------- validation
_HO = "nm AS (SELECT lower(subreddit) AS subreddit, min(tier) AS tier FROM posts GROUP BY 1), hh AS (SELECT *, md5(subreddit || '-42') AS h FROM nm), fi AS (SELECT *, CASE WHEN tier IN ('t1', 't3') AND row_number() OVER (PARTITION BY tier ORDER BY h, subreddit) = 1 THEN 0 ELSE 1 END AS first FROM hh), ho AS (SELECT subreddit, tier FROM fi ORDER BY first, h, subreddit LIMIT 5)"
_add("w9_holdout_communities", lambda p: V.holdout_communities(p), f"WITH {_HO} SELECT * FROM ho")
_add("j8_holdout_posts", lambda p: p.withColumn("_s", F.lower("subreddit")).join(F.broadcast(V.holdout_communities(p).select(c("subreddit").alias("_s"))), "_s", "left_semi").select("post_id"), f"WITH {_HO} SELECT post_id FROM posts WHERE lower(subreddit) IN (SELECT subreddit FROM ho)")
_add("c4_holdout", lambda p: V.holdout(p, percentile=0.8), None)
_add("a60_transfer_matrix", lambda p: V.transfer_matrix(p), None)
_TE = "te AS (SELECT subreddit, threshold, count(*) AS n, (count(*) FILTER (upvotes >= threshold))::DOUBLE / count(*) AS viral_rate FROM (SELECT p.*, quantile_cont(upvotes, 0.75) OVER (PARTITION BY subreddit) AS threshold FROM posts p WHERE created_utc < TIMESTAMP '2024-01-15') GROUP BY ALL)"
_train = lambda p: p.where(c("created_utc") < F.lit("2024-01-15").cast("timestamp"))
_ml = lambda p: V.ml_features(p, M.target_encoding(_train(p).where("subreddit <> 'src5'")))
_ML_SQL = _TE.replace("TIMESTAMP '2024-01-15'", "TIMESTAMP '2024-01-15' AND subreddit <> 'src5'") + ", wh AS (SELECT sum(viral_rate * n) / sum(n) AS rate, median(threshold) AS threshold FROM te)"
_add("j12_encoding_lookup", lambda p: _rounded(_ml(p).select("post_id", "viral_rate"), "viral_rate"), f"WITH {_ML_SQL} SELECT post_id, round(coalesce(viral_rate, rate), 9) AS viral_rate FROM posts LEFT JOIN te USING (subreddit), wh")
_add("m2_labels", lambda p: _ml(p).select("post_id", "label"), f"WITH {_ML_SQL} SELECT post_id, upvotes >= coalesce(te.threshold, wh.threshold) AS label FROM posts LEFT JOIN te USING (subreddit), wh")
_M1 = ("title_words", "body_words", "title_chars", "body_chars", "is_text", "is_t2", "hook_index", "narrative_index", "question", "number", "caps", "starts_how", "paragraphs", "list")
_hooks = "coalesce(list_position([" + ", ".join(map(_q, T.HOOKS)) + "], hook) - 1, -1)"
_modes = "coalesce(list_position([" + ", ".join(map(_q, V._MODES)) + "], narrative) - 1, -1)"
_add("m1_features", lambda p: _rounded(_ml(p).select("post_id", *_M1), "caps"), rf"""WITH {_FEAT} SELECT post_id, title_words::DOUBLE AS title_words, body_words::DOUBLE AS body_words, length(title)::DOUBLE AS title_chars, length(body)::DOUBLE AS body_chars, (content_type = 'text')::INT::DOUBLE AS is_text, (tier = 't2')::INT::DOUBLE AS is_t2,
 ({_hooks})::DOUBLE AS hook_index, ({_modes})::DOUBLE AS narrative_index, contains(title, '?')::INT::DOUBLE AS question, regexp_matches(title, '[0-9]')::INT::DOUBLE AS number, round(len(regexp_extract_all(title, '\p{{Lu}}'))::DOUBLE / greatest(length(title), 1), 9) AS caps,
 starts_with(lower(title), 'how ')::INT::DOUBLE AS starts_how, ({_PAR})::DOUBLE AS paragraphs, regexp_matches(body, '(?m)^\s*[*\-\d+.]\s')::INT::DOUBLE AS list FROM f""")
_GRID8 = [0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]
_GRID = [round(0.1 + 0.02 * i, 2) for i in range(33)]
_scored = lambda p: _ml(p).select(F.round("viral_rate", 9).alias("probability"), "label")
_SW = _ML_SQL + """, sd AS (SELECT round(coalesce(viral_rate, rate), 9) AS probability, upvotes >= coalesce(te.threshold, wh.threshold) AS label FROM posts LEFT JOIN te USING (subreddit), wh), gr AS (SELECT unnest({0}::DOUBLE[]) AS cutoff),
cf AS (SELECT cutoff, count(*) FILTER (probability >= cutoff AND label) AS tp, count(*) FILTER (probability >= cutoff AND NOT label) AS fp, count(*) FILTER (probability < cutoff AND label) AS fn FROM sd, gr GROUP BY 1),
pr AS (SELECT *, tp::DOUBLE / greatest(tp + fp, 1) AS precision, tp::DOUBLE / greatest(tp + fn, 1) AS recall FROM cf), sw AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 0.001) AS f1 FROM pr)"""
_add("m8_sweep", lambda p: _rounded(V.sweep(_scored(p), _GRID8), "precision", "recall", "f1"), f"WITH {_SW.format(_GRID8)} SELECT cutoff, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM sw")
_add("m7_threshold", lambda p: V.calibrated(_rounded(V.sweep(_scored(p), _GRID), "precision", "recall", "f1"), 0.2, 0.6).select("cutoff", "pass", "f1"), f"WITH {_SW.format(_GRID)}, ps AS (SELECT cutoff, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall, CASE WHEN round(precision, 9) >= 0.2 AND round(recall, 9) >= 0.6 AND f1 > 0 THEN 1 WHEN round(precision, 9) >= 0.2 AND recall > 0 THEN 2 ELSE 3 END AS pass FROM sw) SELECT cutoff, pass, f1 FROM ps ORDER BY pass, CASE WHEN pass = 2 THEN recall ELSE f1 END DESC, cutoff LIMIT 1")
_add("m5_boosted", lambda p: V.sweep(V.boosted(p, "2024-01-15"), _GRID8), None)
