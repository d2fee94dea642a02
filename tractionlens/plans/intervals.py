"""Queries of exact tails, resampled intervals and null rates, with SQL that reaches them by other series; importing registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractionlens.functions import special as Z
from tractionlens.functions import text as T
from tractionlens.operators import analysis as A
from tractionlens.operators import mining as M
from tractionlens.operators import resampling as P
from tractionlens.plans.more import _association, _chi_square
from tractionlens.plans.registry import _BW, _CL, _FEAT, _R, _TH, _add

c = F.col
_PI = "3.141592653589793::DOUBLE"


def _rounded(df, *columns: str):
    return df.withColumns({x: F.round(x, 9) + 0.0 for x in columns})


def _t_tails(r: str, n: str) -> str:
    """Two-sided tail of a correlation of n pairs: the finite series in the angle whose tangent is t by the root of the degrees of
    freedom, one for even and one for odd degrees. A term's coefficient is a running product, here a sum of logarithms."""
    series = lambda upto, step: f"(1 + coalesce(list_sum(list_transform(range(1, {upto}), lambda k: exp(k * ln(1 - {r} * {r}) + list_sum(list_transform(range(1, k + 1), lambda j: ln({step})))))), 0.0))"
    even = f"abs({r}) * {series(f'({n} - 2) // 2', '(2 * j - 1) / (2 * j)')}"
    odd = f"2 / {_PI} * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * {series(f'({n} - 3) // 2', '2 * j / (2 * j + 1)')})"
    return f"CASE WHEN {n} < 10 OR {r} = 0 THEN 1.0 WHEN {n} % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END"


_W = f"w AS (SELECT tier, subreddit, {_BW} AS w, upvotes AS u FROM posts)"
_RANKS = "k AS (SELECT subreddit, 2 * rank() OVER (PARTITION BY subreddit ORDER BY w) + count(*) OVER (PARTITION BY subreddit, w) - 1 AS x, 2 * rank() OVER (PARTITION BY subreddit ORDER BY u) + count(*) OVER (PARTITION BY subreddit, u) - 1 AS y FROM w)"


def _correlations(p):
    """Body words against scores per community: Pearson's r and Spearman's rho, each with its exact p."""
    w = p.withColumn("w", T.n_words(c("body")))
    r = A.pearson(w, "w", "upvotes", ["subreddit"]).withColumnRenamed("r", "pearson_r")
    s = A.spearman(w, "w", "upvotes", ["subreddit"]).select("subreddit", c("r").alias("spearman_rho"))
    both = r.join(s, "subreddit")
    return _rounded(both.withColumns({"pearson_p": Z.correlation_p(c("pearson_r"), c("n")), "spearman_p": Z.correlation_p(c("spearman_rho"), c("n"))}), "pearson_r", "pearson_p", "spearman_rho", "spearman_p")


_add("a7_exact_p", _correlations, f"""WITH {_W}, {_RANKS}, r AS (SELECT subreddit, count(*) AS n, {_R.format("w", "u")} AS a FROM w GROUP BY 1), s AS (SELECT subreddit, {_R.format("x", "y")} AS b FROM k GROUP BY 1)
SELECT subreddit, n, round(a, 9) AS pearson_r, round({_t_tails("a", "n")}, 9) + 0.0 AS pearson_p, round(b, 9) AS spearman_rho, round({_t_tails("b", "n")}, 9) + 0.0 AS spearman_p FROM r JOIN s USING (subreddit)""")

#: P of a chi-square value of one degree: Simpson's rule for the normal density over 2,000 steps.
_NORMAL = f"(1 - sqrt(chi2) / 3000 / sqrt(2 * {_PI}) * list_sum(list_transform(range(2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(i * sqrt(chi2) / 2000) * (i * sqrt(chi2) / 2000) / 2))))"
_chi_exact = lambda p: _rounded(_chi_square(p).withColumn("p", Z.chi_square_p(c("chi2"), F.lit(1))).select("hook", "n", "chi2", "p"), "p")
_add("a8_exact_p", _chi_exact, f"""WITH {_FEAT}, {_TH.format(0.9)}, g AS (SELECT hook, (count(*) FILTER (upvotes >= threshold))::DOUBLE AS a, count(*)::DOUBLE AS k FROM f, th GROUP BY 1),
w AS (SELECT hook, a, k - a AS b, sum(a) OVER () - a AS c, sum(k) OVER () - k - sum(a) OVER () + a AS d, sum(k) OVER () AS n FROM g),
x AS (SELECT hook, n::BIGINT AS n, round(CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) <= 0 THEN 0.0 ELSE n * power(greatest(abs(a * d - b * c) - n / 2, 0.0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) END, 9) AS chi2 FROM w)
SELECT hook, n, chi2, round({_NORMAL}, 9) + 0.0 AS p FROM x""")

#: P of a chi-square value of an even number of degrees: a finite Poisson sum.
_add("a8_association_p", lambda p: _rounded(_association(p).withColumn("p", Z.chi_square_p(c("chi2"), c("dof"))), "p"), """WITH o AS (SELECT tier, content_type, count(*) AS o FROM posts GROUP BY ALL),
s AS (SELECT *, sum(o) OVER (PARTITION BY tier) AS r, sum(o) OVER (PARTITION BY content_type) AS k, sum(o) OVER () AS n FROM o),
t AS (SELECT n::BIGINT AS n, count(DISTINCT tier) AS a, count(DISTINCT content_type) AS b, round(n * (sum(o::DOUBLE * o / (r::DOUBLE * k)) - 1), 9) AS chi2 FROM s GROUP BY n)
SELECT n, (a - 1) * (b - 1) AS dof, chi2, round(sqrt(chi2 / (n * least(a - 1, b - 1))), 9) AS v, round(exp(-chi2 / 2) * list_sum(list_transform(range((a - 1) * (b - 1) // 2), lambda i: exp(i * ln(chi2 / 2) - lgamma(i + 1)))), 9) + 0.0 AS p FROM t""")

# ---------------------------------------------------------------- resampled intervals
_DRAWS = 400


def _draws(value: str, by: str) -> str:
    """CTEs from `posts` to w (g, v, draw, w): the weight of each distinct value in each draw."""
    return f"""k AS (SELECT {by} AS g, {value} AS v, count(*) AS k FROM posts WHERE {value} IS NOT NULL GROUP BY ALL),
pt AS (SELECT k, list_transform(range(greatest(0, floor(k - 12 * sqrt(k) - 40)::BIGINT), floor(k + 12 * sqrt(k) + 40)::BIGINT + 1), lambda w: w) AS ws FROM (SELECT DISTINCT k FROM k)),
pu AS (SELECT k, w, sum(exp(w * ln(k) - k - lgamma(w + 1))) OVER (PARTITION BY k ORDER BY w) AS upto FROM (SELECT k, unnest(ws) AS w FROM pt)),
u AS (SELECT g, v, k, draw, ('0x' || substring(md5('42-' || g || '-' || v || '-' || draw), 1, 13))::BIGINT / 4503599627370496 AS u FROM k, (SELECT unnest(range({_DRAWS})) AS draw)),
w AS (SELECT g, v, draw, min(w) AS w FROM u JOIN pu USING (k) WHERE upto >= u GROUP BY g, v, draw)"""


_add("a9_bootstrap_interval", lambda p: _rounded(P.bootstrap(p, "upvotes", "tier", draws=_DRAWS), "lower", "middle", "upper"), f"""WITH {_draws("upvotes", "tier")}, m AS (SELECT g, draw, sum(w * v)::DOUBLE / sum(w) AS s FROM w GROUP BY ALL HAVING sum(w) > 0)
SELECT g AS tier, (SELECT count(*) FROM posts WHERE tier = g) AS n, round(quantile_cont(s, 0.025), 9) AS lower, round(avg(s), 9) AS middle, round(quantile_cont(s, 0.975), 9) AS upper FROM m GROUP BY g""")
_add("a9_bootstrap_median", lambda p: _rounded(P.bootstrap(p, "num_comments", "subreddit", P.median_of, draws=_DRAWS), "lower", "middle", "upper"), f"""WITH {_draws("num_comments", "subreddit")}, x AS (SELECT *, sum(w) OVER (PARTITION BY g, draw ORDER BY v) AS upto, sum(w) OVER (PARTITION BY g, draw) / 2 AS half FROM w),
m AS (SELECT g, draw, (min(v) FILTER (upto >= half) + min(v) FILTER (upto > half)) / 2 AS s FROM x GROUP BY ALL HAVING sum(w) > 0)
SELECT g AS subreddit, (SELECT count(*) FROM posts WHERE subreddit = g) AS n, round(quantile_cont(s, 0.025), 9) AS lower, round(avg(s), 9) AS middle, round(quantile_cont(s, 0.975), 9) AS upper FROM m GROUP BY g""")

# ---------------------------------------------------------------- null rates
_keys = ("tier", "hook", "narrative", "content_type")
_null = lambda p: _rounded(P.null_interval(M.clusters(M.features(p))).select(*_keys, "viral", "n", "null_lower", "null_upper"), "null_lower", "null_upper")
_AT = "min(i / n) FILTER (upto >= {0} - 1e-12)"
_add("a44_null_interval", _null, f"""WITH {_FEAT}, {_TH.format(0.9)}, {_CL}, p AS (SELECT sum(viral) / sum(n) AS p FROM cl), s AS (SELECT {", ".join(_keys)}, viral, n, p, unnest(range(n + 1)) AS i FROM cl, p),
u AS (SELECT *, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))) OVER (PARTITION BY {", ".join(_keys)} ORDER BY i) AS upto FROM s)
SELECT {", ".join(_keys)}, viral, n, round({_AT.format(0.025)}, 9) AS null_lower, round({_AT.format(0.975)}, 9) AS null_upper FROM u GROUP BY ALL""")
