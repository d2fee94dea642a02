"""The registered queries and their SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractionlens.functions import text as T
from tractionlens.operators import analysis as A
from tractionlens.operators import feedback as B
from tractionlens.operators import mining as M
from tractionlens.sources import files as X
from tractionlens.sources import posts as S

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, d: build(S.posts(spark, d))
    if sql:
        ORACLES[name] = f"WITH {S.POSTS_SQL}, {sql.lstrip()[5:]}" if sql.lstrip().startswith("WITH ") else f"WITH {S.POSTS_SQL} {sql}"


def _add_f(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, d: build(S.feedback(spark, d))
    ORACLES[name] = f"WITH {S.FEEDBACK_SQL}, {sql.lstrip()[5:]}" if sql.lstrip().startswith("WITH ") else f"WITH {S.FEEDBACK_SQL} {sql}"


def _q(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _hits(column: str, words) -> str:
    return "(" + " + ".join(f"contains(lower({column}), {_q(w)})::INT" for w in words) + ")"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {_q(w)})" for w in words) + ")"


def _hook(column: str) -> str:
    scores = "[" + ", ".join(_hits(column, v) for v in T.HOOKS.values()) + "]"
    names = "[" + ", ".join(map(_q, T.HOOKS)) + "]"
    cases = f"WHEN list_max({scores}) > 0 THEN {names}[list_position({scores}, list_max({scores}))]"
    number = f"regexp_matches({column}, '[0-9]')"
    first = f"contains({column}, '?') AND NOT {number} THEN 'curious_question' WHEN {_any(column, (' vs ', ' versus '))} THEN 'comparison_analysis' WHEN contains(substring(lower({column}), 1, 30), 'how to') THEN 'tutorial_howto'"
    story = rf"regexp_matches(lower({column}), '(^|[^\p{{L}}\p{{N}}_])i($|[^\p{{L}}\p{{N}}_])') AND length({column}) > 50"
    return f"CASE WHEN {first} {cases} WHEN {number} THEN 'number_shock' WHEN {story} THEN 'story_opener' ELSE 'curious_question' END"


_NARRATIVE = (
    f"CASE WHEN length(body) < 20 THEN 'no_body' WHEN {_any('body', T.TUTORIAL)} THEN 'tutorial_howto' WHEN {_any('body', T.OPINION)} THEN 'opinion_argument' WHEN {_any('body', T.SHOWCASE)} THEN 'resource_showcase' "
    f"WHEN ends_with(rtrim(body), '?') OR contains(lower(body), 'anyone else') THEN 'question_discussion' WHEN {_any('body', T.PERSONAL)} AND length(body) > 200 THEN 'story_personal' ELSE 'opinion_argument' END"
)
_NW = "len(regexp_extract_all({0}, '[^\\s]+'))"
_TW, _BW = _NW.format("title"), _NW.format("body")
_P, _N = _hits("title", T.POSITIVE), _hits("title", T.NEGATIVE)
_POLARITY = f"CASE WHEN {_P} > {_N} THEN 'positive' WHEN {_N} > {_P} THEN 'negative' ELSE 'neutral' END"
_DEV = "sqrt((count(*)::DOUBLE * sum({0}*{0})::DOUBLE - sum({0})::DOUBLE * sum({0})::DOUBLE) / (count(*)::DOUBLE * count(*)::DOUBLE))"
_FEAT = f"f AS (SELECT *, {_hook('title')} AS hook, {_NARRATIVE} AS narrative, {_TW} AS title_words, {_BW} AS body_words FROM posts)"
_AS_OF = "2024-06-01 00:00:00"
c = F.col

# ---------------------------------------------------------------- filters
_add("f1_posts_of_community", lambda p: p.where("subreddit = 'src3'").orderBy(F.desc("upvotes"), "post_id").select("post_id", "upvotes"), "SELECT post_id, upvotes FROM posts WHERE subreddit = 'src3' ORDER BY upvotes DESC, post_id")
_add("f2_posts_of_tier", lambda p: p.where("tier = 't1'").orderBy(F.desc("upvotes"), "post_id").select("post_id", "upvotes"), "SELECT post_id, upvotes FROM posts WHERE tier = 't1' ORDER BY upvotes DESC, post_id")
_add("f3_community_list", lambda p: p.where(F.lower("subreddit").isin("src1", "src7")).select("post_id"), "SELECT post_id FROM posts WHERE lower(subreddit) IN ('src1', 'src7')")
_add("f4_time_window", lambda p: p.where("created_utc IS NULL OR created_utc >= timestamp'2024-01-10 00:00:00'").select("post_id"), "SELECT post_id FROM posts WHERE created_utc IS NULL OR created_utc >= TIMESTAMP '2024-01-10 00:00:00'")
_add("f5_quality_filter", lambda p: p.where("upvotes >= 1 AND title <> ''").join(p.where("num_comments > 4").select("post_id"), "post_id", "left_anti").select("post_id"), "SELECT post_id FROM posts WHERE upvotes >= 1 AND title <> '' AND post_id NOT IN (SELECT post_id FROM posts WHERE num_comments > 4)")
_add("f6_tier_thresholds", lambda p: p.where(c("upvotes") >= F.when(c("tier") == "t1", 100).when(c("tier") == "t2", 50).otherwise(20)).select("post_id", "tier"), "SELECT post_id, tier FROM posts WHERE upvotes >= CASE tier WHEN 't1' THEN 100 WHEN 't2' THEN 50 ELSE 20 END")
_add("f7_temporal_split", lambda p: p.where("created_utc IS NOT NULL").select("post_id", F.when(c("created_utc") < F.lit("2024-01-15").cast("timestamp"), "train").otherwise("test").alias("split")), "SELECT post_id, CASE WHEN created_utc < TIMESTAMP '2024-01-15' THEN 'train' ELSE 'test' END AS split FROM posts WHERE created_utc IS NOT NULL")
_add("f8_body_present", lambda p: p.where(F.length("body") >= 20).select("post_id"), "SELECT post_id FROM posts WHERE length(body) >= 20")
_add("f9_controversial", lambda p: p.where("upvote_ratio > 0 AND upvote_ratio < 0.75 AND num_comments > 0").select("post_id"), "SELECT post_id FROM posts WHERE upvote_ratio > 0 AND upvote_ratio < 0.75 AND num_comments > 0")
_add_f("f10_history_of_user", lambda f: B.history_of(f, user=7, community="SRC0", newest=20).select("event_id", "subreddit", "actual_upvotes"), "SELECT event_id, subreddit, actual_upvotes FROM feedback WHERE user_id = 7 AND lower(subreddit) = 'src0' ORDER BY tracked_at DESC, event_id DESC LIMIT 20")
QUERIES["f12_ad_hoc_sql"] = lambda spark, d: spark.sql("SELECT subreddit, count(*) AS n, sum(upvotes) AS total FROM {p} WHERE upvotes >= :least GROUP BY subreddit", args={"least": 10}, p=S.posts(spark, d))
ORACLES["f12_ad_hoc_sql"] = f"WITH {S.POSTS_SQL} SELECT subreddit, count(*) AS n, sum(upvotes)::BIGINT AS total FROM posts WHERE upvotes >= 10 GROUP BY subreddit"
_media = lambda rules: X.media_type(F.coalesce("url", F.lit("")), rules, F.coalesce(c("url") == "", F.lit(True)), F.contains(F.lower("url"), F.lit("video")), F.lit(""))
QUERIES["f13_media_from_url"] = lambda spark, d: S.table(spark, d, "pages").select("page_id", *[_media(r).alias(r) for r in ("table", "dump", "archive")])
_MARK = lambda words: "(" + " OR ".join(f"contains(lower(u), {_q(w)})" for w in words) + ")"
ORACLES["f13_media_from_url"] = f"""WITH x AS (SELECT page_id, coalesce(url, '') AS u FROM pages) SELECT page_id,
 CASE WHEN {_MARK([".jpg", ".png", ".gif", "imgur.com", "i.redd.it"])} THEN CASE WHEN {_MARK([".gif", "gfycat"])} THEN 'video' ELSE 'image' END WHEN {_MARK(["youtube.com", "youtu.be", "v.redd.it"])} THEN 'video' WHEN u LIKE 'http%' THEN 'link' ELSE 'text' END AS "table",
 CASE WHEN {_MARK(["video"])} THEN 'video' WHEN u <> '' AND {_MARK([".jpg", ".png", ".gif", "imgur.com", "i.redd.it"])} THEN 'image' WHEN u LIKE 'http%' THEN 'link' ELSE 'text' END AS dump,
 CASE WHEN {_MARK([".jpg", ".png", ".gif", "imgur.com", "i.redd.it"])} THEN 'image' WHEN contains(u, 'v.redd.it') THEN 'video' WHEN u <> '' THEN 'link' ELSE 'text' END AS archive FROM x"""

# ---------------------------------------------------------------- counts, profiles, distributions
_add("a1_counts", lambda p: A.counts(p, ["subreddit", "tier", "content_type"]), "SELECT 'subreddit' AS dimension, subreddit AS value, count(*) AS n FROM posts GROUP BY ALL UNION ALL SELECT 'tier', tier, count(*) FROM posts GROUP BY ALL UNION ALL SELECT 'content_type', content_type, count(*) FROM posts GROUP BY ALL")
_add("a2_coverage_gaps", lambda p: A.gaps(p, p.select("subreddit"), 60), "SELECT subreddit, count(*) AS n, 60 - count(*) AS shortfall FROM posts GROUP BY subreddit HAVING count(*) < 60")
_add("a4_profile", lambda p: A.profile(p, "subreddit"), "SELECT subreddit, count(*) AS n, min(upvotes) AS min_upvotes, max(upvotes) AS max_upvotes, avg(upvotes) AS avg_upvotes, strftime(min(created_utc), '%Y-%m-%d') AS first_day, strftime(max(created_utc), '%Y-%m-%d') AS last_day FROM posts GROUP BY subreddit")
_HIST = "e AS (SELECT min(upvotes)::DOUBLE AS lo, max(upvotes)::DOUBLE AS hi FROM posts), h AS (SELECT least(floor((upvotes - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n FROM posts, e GROUP BY 1)"
_add("a5_histogram", lambda p: A.histogram(p, "upvotes"), f"WITH {_HIST} SELECT bin, n FROM h")
_DIST = "SELECT {1} count(*) AS n, avg({0}) AS mean, " + _DEV + " AS std, " + ", ".join(f"quantile_cont({{0}}, {x / 100}) AS p{x}" for x in (10, 25, 50, 75, 90, 95, 99)) + " FROM {2} {3}"
_add("a5_distribution_by_tier", lambda p: A.distribution(p, "upvotes", ["tier"]), _DIST.format("upvotes", "tier,", "posts", "GROUP BY tier"))
_add("a23_word_distribution", lambda p: A.distribution(p.where(F.length("body") >= 20).withColumn("w", T.n_words(c("body"))), "w", []), f"WITH w AS (SELECT {_BW} AS w FROM posts WHERE length(body) >= 20) " + _DIST.format("w", "", "w", ""))
_add("a6_inflections", lambda p: A.inflections(A.histogram(p, "upvotes")), f"WITH {_HIST}, full_ AS (SELECT r.b AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) AS b) r LEFT JOIN h ON h.bin = r.b), d AS (SELECT bin, sign(n - 2 * lag(n) OVER (ORDER BY bin) + lag(n, 2) OVER (ORDER BY bin)) AS s FROM full_), g AS (SELECT bin, s, lag(s) OVER (ORDER BY bin) AS p FROM d) SELECT bin - 1 AS bin FROM g WHERE s * p < 0")
_R = "CASE WHEN count(*) < 10 OR count(*)*sum({0}*{0}) - sum({0})*sum({0}) <= 0 OR count(*)*sum({1}*{1}) - sum({1})*sum({1}) <= 0 THEN 0.0 ELSE (count(*)*sum({0}*{1}) - sum({0})*sum({1}))::DOUBLE / (sqrt((count(*)*sum({0}*{0}) - sum({0})*sum({0}))::DOUBLE) * sqrt((count(*)*sum({1}*{1}) - sum({1})*sum({1}))::DOUBLE)) END"
_add("a7_pearson", lambda p: A.pearson(p.withColumn("w", T.n_words(c("body"))), "w", "upvotes", ["tier"]), f"WITH w AS (SELECT tier, {_BW} AS w, upvotes AS u FROM posts) SELECT tier, count(*) AS n, {_R.format('w', 'u')} AS r FROM w GROUP BY tier")
_add("a7_spearman", lambda p: A.spearman(p.withColumn("w", T.n_words(c("body"))), "w", "upvotes", ["tier"]), f"WITH w AS (SELECT tier, {_BW} AS w, upvotes AS u FROM posts), k AS (SELECT tier, 2 * rank() OVER (PARTITION BY tier ORDER BY w) + count(*) OVER (PARTITION BY tier, w) - 1 AS x, 2 * rank() OVER (PARTITION BY tier ORDER BY u) + count(*) OVER (PARTITION BY tier, u) - 1 AS y FROM w) SELECT tier, count(*) AS n, {_R.format('x', 'y')} AS r FROM k GROUP BY tier")
_add("a10_cohens_d", lambda p: A.cohens_d(p, "upvotes", c("content_type") == "text", ["tier"]), """WITH s AS (SELECT tier, count(*) FILTER (content_type = 'text') AS n1, count(*) FILTER (content_type <> 'text') AS n0, sum(upvotes) FILTER (content_type = 'text') AS s1, sum(upvotes) FILTER (content_type <> 'text') AS s0, sum(upvotes * upvotes) FILTER (content_type = 'text') AS q1, sum(upvotes * upvotes) FILTER (content_type <> 'text') AS q0 FROM posts GROUP BY tier),
v AS (SELECT *, (n1::DOUBLE * q1::DOUBLE - s1::DOUBLE * s1::DOUBLE) / (n1::DOUBLE * (n1::DOUBLE - 1)) AS v1, (n0::DOUBLE * q0::DOUBLE - s0::DOUBLE * s0::DOUBLE) / (n0::DOUBLE * (n0::DOUBLE - 1)) AS v0 FROM s)
SELECT tier, (s1::DOUBLE / n1::DOUBLE - s0::DOUBLE / n0::DOUBLE) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d FROM v""")
_add("a11_inliers", lambda p: A.inliers(p.select("post_id", "tier", "upvotes"), "upvotes", ["tier"]), "WITH q AS (SELECT tier, quantile_cont(upvotes, 0.25) AS a, quantile_cont(upvotes, 0.75) AS b FROM posts GROUP BY tier) SELECT tier, post_id, upvotes FROM posts JOIN q USING (tier) WHERE upvotes >= a - (b - a) * 1.5 AND upvotes <= b + (b - a) * 1.5")
_add("a12_percentile_rank", lambda p: p.agg(((F.count_if(c("upvotes") < 25) + F.count_if(c("upvotes") <= 25) + F.when(F.count_if(c("upvotes") == 25) > 0, 1).otherwise(0)) * 50.0 / F.count("*")).alias("percentile_rank")), "SELECT (count(*) FILTER (upvotes < 25) + count(*) FILTER (upvotes <= 25) + CASE WHEN count(*) FILTER (upvotes = 25) > 0 THEN 1 ELSE 0 END) * 50.0::DOUBLE / count(*) AS percentile_rank FROM posts")
_add("a13_optimal_range", lambda p: A.optimal_range(p.withColumn("w", T.n_words(c("title"))), "w", "upvotes", ["tier"]), f"""WITH r AS (SELECT tier, {_TW} AS m, post_id, upvotes AS u FROM posts),
k AS (SELECT *, row_number() OVER w AS i, sum(u) OVER (PARTITION BY tier ORDER BY m, post_id ROWS UNBOUNDED PRECEDING) AS c, count(*) OVER (PARTITION BY tier) AS n FROM r WINDOW w AS (PARTITION BY tier ORDER BY m, post_id)),
b AS (SELECT a.tier, a.i, a.m, z.m AS hi, z.c - (a.c - a.u) AS s FROM k a JOIN k z ON a.tier = z.tier AND z.i = a.i + greatest(5, a.n // 5) - 1 WHERE a.i <= a.n - greatest(5, a.n // 5)),
t AS (SELECT * FROM b WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY tier ORDER BY s DESC, i) = 1)
SELECT tier, m AS low, hi AS high FROM t""")
_add("a14_keywords_by_community", lambda p: A.keywords(p, "title", T.STOP_WORDS, 3, 20, ["subreddit"]), "WITH w AS (SELECT subreddit, unnest(regexp_extract_all(lower(title), '[a-z]{3,}')) AS word FROM posts), k AS (SELECT subreddit, word, count(*) AS n FROM w WHERE word NOT IN (" + ", ".join(map(_q, T.STOP_WORDS)) + ") GROUP BY ALL HAVING count(*) >= 3) SELECT subreddit, word, n, row_number() OVER (PARTITION BY subreddit ORDER BY n DESC, word)::INT AS rank FROM k QUALIFY rank <= 20")

# ---------------------------------------------------------------- titles and bodies
_STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_DASH = "(contains(title, '—') OR contains(title, ' - '))"
_FLAGS = {"colon": "contains(title, ':')", "dash": _DASH, "parenthesis": "contains(title, '(')", "number": r"regexp_matches(title, '\p{Nd}')", "question": f"ends_with({_STRIP.format('title')}, '?')"}
_rate_of = lambda flags: ", ".join(f"(count(*) FILTER ({v}))::DOUBLE / count(*) AS {k}" for k, v in flags.items())
_add("a15_title_rates", lambda p: A.rates(p.where("title <> ''"), A.title_flags(), ["tier"]), f"SELECT tier, count(*) AS n, {_rate_of(_FLAGS)} FROM posts WHERE title <> '' GROUP BY tier")
_SLOTS = {"colon": _FLAGS["colon"], "dash": _DASH, "question": "ends_with(title, '?')", "number": _FLAGS["number"], "bracket": "(contains(title, '[') OR contains(title, '('))"}
_add("a16_templates", lambda p: A.templates(p), "WITH g AS (SELECT " + " || '|' || ".join(f"CASE WHEN {v} THEN '{k}' ELSE '' END" for k, v in _SLOTS.items()) + " AS template, count(*) AS n, avg(upvotes) AS avg_upvotes FROM posts WHERE title <> '' GROUP BY 1), t AS (SELECT * FROM g ORDER BY n DESC, template LIMIT 10) SELECT * FROM t WHERE n >= 5")
_CLASS = "SELECT {1} {0} AS {2}, count(*) AS n, sum(upvotes)::BIGINT AS total, avg(upvotes) AS avg_upvotes, " + _DEV.format("upvotes") + " AS std, count(*)::DOUBLE / sum(count(*)) OVER ({3}) AS share FROM posts {4} GROUP BY {1} {0}"
_add("a17_sentiment", lambda p: A.class_stats(p, T.polarity(c("title")), "polarity", []), _CLASS.format(_POLARITY, "", "polarity", "", ""))
_add("a18_hook_stats_by_tier", lambda p: A.class_stats(p, T.hook_type(c("title")), "hook", ["tier"]), _CLASS.format(_hook("title"), "tier,", "hook", "PARTITION BY tier", ""))
_add("a19_capitals", lambda p: A.rates(p, {"all_caps": (F.upper("title") == c("title")) & (F.length("title") > 10), "mixed": (F.upper("title") != c("title")) & c("title").rlike("[A-Z]")}, []), "SELECT count(*) AS n, (count(*) FILTER (upper(title) = title AND length(title) > 10))::DOUBLE / count(*) AS all_caps, (count(*) FILTER (upper(title) <> title AND regexp_matches(title, '[A-Z]')))::DOUBLE / count(*) AS mixed FROM posts")
_add("a20_temporality", lambda p: A.gain(p.where("title <> ''"), T.hits(c("title"), ("was", "now", "der", "est")) > 0), "WITH t AS (SELECT upvotes, " + _hits("title", ("was", "now", "der", "est")) + " > 0 AS x FROM posts WHERE title <> '') SELECT avg(x::INT)::DOUBLE AS rate, avg(upvotes) FILTER (x) - avg(upvotes) FILTER (NOT x) AS gain FROM t")
_add("a20_time_words", lambda p: A.gain(p.where("title <> ''"), T.hits(c("title"), T.TIME_WORDS) > 0), f"WITH t AS (SELECT upvotes, {_any('title', T.TIME_WORDS)} AS x FROM posts WHERE title <> '') SELECT avg(x::INT)::DOUBLE AS rate, coalesce(avg(upvotes) FILTER (x) - avg(upvotes) FILTER (NOT x), 0.0) AS gain FROM t")
_BODIES = lambda p: p.where(F.length("body") >= 20)
_BFLAGS = {
    "list": r"regexp_matches(body, '(?m)^[-*0-9+.][ \t\n\r\f\v]')",
    "tldr": r"regexp_matches(body, '(?i)\bTL[;:]?DR\b')",
    "bold": "contains(body, '**')",
    "quote": "(starts_with(body, '>') OR contains(body, chr(10) || '>'))",
    "ending_question": f"ends_with({_STRIP.format('body')}, '?')",
    "call_to_action": _any("body", T.CALLS),
}
_add("a21_body_rates", lambda p: A.rates(_BODIES(p), A.body_flags(), ["tier"]), f"SELECT tier, count(*) AS n, {_rate_of(_BFLAGS)} FROM posts WHERE length(body) >= 20 GROUP BY tier")
_add("a24_narrative_stats", lambda p: A.class_stats(p, T.narrative_mode(c("body")), "narrative", []), _CLASS.format(_NARRATIVE, "", "narrative", "", ""))
_OPENING = "CASE WHEN ends_with({0}, '?') THEN 'rhetorical_question' " + " ".join(f"WHEN {_any('{0}', v)} THEN '{k}'" for k, v in T.OPENINGS.items()) + " ELSE 'background_first' END"
_add("a24_opening_stats", lambda p: A.class_stats(_BODIES(p), T.opening(c("body")), "opening", []), _CLASS.format(_OPENING.format("lower(string_split(substring(body, 1, 200), '.')[1])"), "", "opening", "", "WHERE length(body) >= 20"))
_add("t1_text_metrics", lambda p: p.select("post_id", F.length("body").cast("long").alias("chars"), T.n_words(c("body")).alias("words"), T.n_sentences(c("body")).alias("sentences")), f"SELECT post_id, length(body)::BIGINT AS chars, {_BW}::BIGINT AS words, len(list_filter(regexp_split_to_array(body, '[.!?]+'), lambda s: trim(s) <> ''))::BIGINT AS sentences FROM posts")

# ---------------------------------------------------------------- time, media, lifecycle
_CUT = "cut AS (SELECT upvotes AS cutoff FROM (SELECT upvotes, row_number() OVER (ORDER BY upvotes DESC) AS i, count(*) OVER () AS n FROM posts) WHERE i = greatest(1, n // 10))"
_SLOT = "WITH {3}, g AS (SELECT {0} AS {1}, count(*) AS n, avg(upvotes) AS a, (count(*) FILTER (upvotes >= cutoff))::DOUBLE / count(*) AS t FROM posts, cut WHERE created_utc IS NOT NULL GROUP BY 1) SELECT r.{1}, coalesce(n, 0) AS n, coalesce(a, 0.0) AS avg_upvotes, coalesce(t, 0.0) AS top_share FROM (SELECT unnest(range({2})) AS {1}) r LEFT JOIN g USING ({1})"
_DCUT = _CUT.replace("FROM posts)", "FROM posts WHERE created_utc IS NOT NULL)")
_add("a25_day_of_week", lambda p: A.slot_stats(p, F.weekday("created_utc").cast("long"), p.sparkSession.range(7).toDF("day"), "day"), _SLOT.format("isodow(created_utc) - 1", "day", 7, _DCUT))
_add("a26_hour_of_day", lambda p: A.slot_stats(p, F.hour("created_utc").cast("long"), p.sparkSession.range(24).toDF("hour"), "hour"), _SLOT.format("hour(created_utc)", "hour", 24, _DCUT))
_add("a27_time_matrix", lambda p: A.time_matrix(p), "SELECT strftime(created_utc, '%a_%H') AS slot, count(*) AS n, avg(upvotes) AS avg_upvotes, median(upvotes)::DOUBLE AS median, median(upvotes)::DOUBLE / (SELECT greatest(median(upvotes)::DOUBLE, 1.0) FROM posts WHERE created_utc IS NOT NULL) AS lift FROM posts WHERE created_utc IS NOT NULL GROUP BY 1")
_add("a28_flair", lambda p: A.flairs(p), "WITH s AS (" + _CLASS.format("lower(flair)", "", "flair", "", "WHERE flair <> ''") + ") SELECT *, (SELECT (count(*) FILTER (flair <> ''))::DOUBLE / count(*) FROM posts) AS flair_rate FROM s")
_add("a29_preferences", lambda p: A.preferences(p), f"WITH w AS (SELECT subreddit, {_TW} AS t, CASE WHEN length(body) > 0 THEN {_BW} END AS b, upvotes FROM posts) SELECT subreddit, floor(quantile_cont(t, 0.25))::BIGINT AS title_words_low, floor(quantile_cont(t, 0.75))::BIGINT AS title_words_high, floor(quantile_cont(b, 0.25))::BIGINT AS body_words_low, floor(quantile_cont(b, 0.75))::BIGINT AS body_words_high, median(upvotes)::DOUBLE AS median, count(*) AS n FROM w GROUP BY subreddit")
_add("a30_specificity", lambda p: A.specificity(p), f"WITH w AS (SELECT subreddit, CASE WHEN title <> '' THEN {_TW} END AS t, CASE WHEN body <> '' THEN {_BW} END AS b FROM posts), x AS (SELECT coalesce(median(t)::DOUBLE, 0) AS a, coalesce(median(b)::DOUBLE, 0) AS b FROM w), y AS (SELECT subreddit, coalesce(median(t)::DOUBLE, 0) AS a, coalesce(median(b)::DOUBLE, 0) AS b FROM w GROUP BY subreddit HAVING count(*) >= 20) SELECT subreddit, least((abs(y.a - x.a) / greatest(x.a, 1.0) + abs(y.b - x.b) / greatest(x.b, 1.0)) / 2, 1.0) AS score FROM y, x")
_V = f"upvotes / greatest((epoch(TIMESTAMP '{_AS_OF}') - floor(epoch(created_utc))) / 3600, 1.0)"
_add("a31_velocity", lambda p: p.where("created_utc IS NOT NULL").select("post_id", A.velocity(p, _AS_OF).alias("velocity")), f"SELECT post_id, {_V} AS velocity FROM posts WHERE created_utc IS NOT NULL")
_add("a31_velocity_profile", lambda p: A.velocity_profile(p, _AS_OF).select("n", F.round("r", 9).alias("r"), F.round("threshold", 9).alias("threshold")), f"WITH {_DCUT}, v AS (SELECT upvotes, {_V} AS v FROM posts WHERE created_utc IS NOT NULL) SELECT count(*) AS n, round(corr(v, upvotes), 9) AS r, round((SELECT quantile_cont(v, 0.2) FROM v, cut WHERE upvotes >= cutoff), 9) AS threshold FROM v")
_add("a32_controversy", lambda p: A.controversy(p), "SELECT count(*) AS n, coalesce(avg(upvotes), 0.0) AS avg_upvotes, coalesce(avg(num_comments), 0.0) AS avg_comments, coalesce(median(upvote_ratio), 0.0) AS median_upvote_ratio, coalesce(avg((coalesce(flair, '') <> '')::INT), 0.0) AS flair_usage, coalesce(avg(num_comments / greatest(upvotes, 1)), 0.0) AS engagement_per_upvote FROM posts WHERE upvote_ratio > 0 AND upvote_ratio < 0.75 AND num_comments > 0")
_ICUT = "cut AS (SELECT upvotes AS cutoff FROM (SELECT upvotes, row_number() OVER (ORDER BY upvotes DESC) AS i, count(*) OVER () AS n FROM posts) WHERE i = n // 10 + 1)"
_add("a33_media_stats", lambda p: A.media_stats(p), f"WITH {_ICUT}, t AS (SELECT content_type AS media, (count(*) FILTER (upvotes >= cutoff))::DOUBLE / count(*) AS top_share FROM posts, cut GROUP BY 1), s AS (" + _CLASS.format("content_type", "", "media", "", "") + ") SELECT s.*, top_share FROM s JOIN t USING (media)")
_spelled = lambda: F.array_join(F.transform(F.map_entries("distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
_add("a34_dominant_media", lambda p: A.dominant_media(p).withColumn("distribution", _spelled()), "WITH g AS (SELECT subreddit, content_type, count(*) AS n FROM posts GROUP BY ALL) SELECT subreddit, content_type AS dominant, n::DOUBLE / (sum(n) OVER (PARTITION BY subreddit))::DOUBLE AS share, (SELECT string_agg(h.content_type || '=' || h.n, ',' ORDER BY h.content_type) FROM g h WHERE h.subreddit = g.subreddit) AS distribution FROM g QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY n DESC, content_type DESC) = 1")
_add("a36_media_return", lambda p: A.media_return(p), "SELECT content_type, count(*) AS n, avg(upvotes) AS avg_upvotes, avg(num_comments) AS avg_comments, avg(upvote_ratio) AS avg_ratio, CASE WHEN content_type <> 'text' THEN avg(upvotes) / greatest((SELECT avg(upvotes) FROM posts WHERE content_type = 'text'), 1.0) END AS boost FROM posts WHERE content_type IN ('text', 'image', 'video') GROUP BY content_type")
_GROWTH = f"""CASE WHEN upvotes <= 0 OR created_utc IS NULL THEN 'unknown' WHEN {_V} > 100 THEN 'exponential' WHEN num_comments / greatest(upvotes, 1) > 1.5 AND upvotes > 100 THEN 'impulsive' WHEN num_comments / greatest(upvotes, 1) > 0.5 AND upvotes > 500 THEN 'bimodal' WHEN num_comments / greatest(upvotes, 1) > 0.05 AND num_comments / greatest(upvotes, 1) < 0.5 THEN 'linear' ELSE 'logarithmic' END"""
_add("a37_growth_classes", lambda p: A.growth_classes(p, _AS_OF), f"WITH g AS (SELECT {_GROWTH} AS growth FROM posts) SELECT r.growth, count(g.growth) AS n, count(g.growth)::DOUBLE / (SELECT count(*) FROM g) AS share FROM (SELECT unnest(['exponential', 'impulsive', 'bimodal', 'linear', 'logarithmic', 'unknown']) AS growth) r LEFT JOIN g USING (growth) GROUP BY r.growth")
_REFS = "refs AS (SELECT d.source AS source_subreddit, 't3_' || m.target AS target_post_id FROM documents d JOIN (SELECT text, min(doc_id) AS target FROM documents GROUP BY text HAVING count(DISTINCT source) > 1) m ON m.text = d.text WHERE d.doc_id <> m.target)"
QUERIES["a38_propagation_edges"] = lambda spark, d: A.crossrefs(S.table(spark, d, "documents")).groupBy("source_subreddit").agg(F.count("*").alias("n"))
ORACLES["a38_propagation_edges"] = f"WITH {_REFS} SELECT source_subreddit, count(*) AS n FROM refs GROUP BY 1"
QUERIES["a39_propagation_paths"] = lambda spark, d: A.propagation(A.crossrefs(S.table(spark, d, "documents")), S.posts(spark, d))
ORACLES["a39_propagation_paths"] = f"WITH {S.POSTS_SQL}, {_REFS}, e AS (SELECT source_subreddit, subreddit AS target, count(*) AS n FROM refs JOIN posts ON post_id = target_post_id GROUP BY ALL) SELECT source_subreddit, target, n, n::DOUBLE / (sum(n) OVER (PARTITION BY source_subreddit))::DOUBLE AS share FROM e ORDER BY n DESC, source_subreddit, target LIMIT 20"
QUERIES["a40_spread"] = lambda spark, d: A.spread(S.posts(spark, d), A.crossrefs(S.table(spark, d, "documents")))
ORACLES["a40_spread"] = f"WITH {S.POSTS_SQL}, {_REFS} SELECT content_type, count(*) AS n, (count(*) FILTER (post_id IN (SELECT target_post_id FROM refs)))::DOUBLE / count(*) AS spread FROM posts GROUP BY content_type"

# ---------------------------------------------------------------- dedup, top-k, set operations
_add("w2_dedup_by_title", lambda p: A.latest(p, "title", [F.desc("upvotes"), "doc_id"]).select("post_id"), "SELECT post_id FROM posts QUALIFY row_number() OVER (PARTITION BY title ORDER BY upvotes DESC, doc_id) = 1")
_add("w4_top_decile_cutoff", lambda p: A.cutoff(p, False), f"WITH {_CUT} SELECT cutoff FROM cut")
_add("w5_index_cutoff", lambda p: A.cutoff(p, True), "SELECT upvotes AS cutoff FROM (SELECT upvotes, row_number() OVER (ORDER BY upvotes DESC) AS i, count(*) OVER () AS n FROM posts) WHERE i = n // 10 + 1")
QUERIES["l1_top_comments"] = lambda spark, d: A.top_per(S.comments(spark, d), "post_id", [F.desc("upvotes"), "comment_id"], 3)
ORACLES["l1_top_comments"] = "SELECT conv_id AS post_id, turn AS depth, length(text)::BIGINT AS upvotes, conv_id || '_' || turn AS comment_id, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, conv_id || '_' || turn)::INT AS rank FROM conversations QUALIFY rank <= 3"
QUERIES["l2_deep_threads"] = lambda spark, d: A.top_per(S.comments(spark, d).where("depth >= 3"), "post_id", [F.desc("depth"), "comment_id"], 5)
ORACLES["l2_deep_threads"] = "SELECT conv_id AS post_id, turn AS depth, length(text)::BIGINT AS upvotes, conv_id || '_' || turn AS comment_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, conv_id || '_' || turn)::INT AS rank FROM conversations WHERE turn >= 3 QUALIFY rank <= 5"
_add("l6_community_cap", lambda p: A.top_per(p, "subreddit", [F.desc("upvotes"), "post_id"], 10).select("post_id", "subreddit", "rank"), "SELECT post_id, subreddit, row_number() OVER (PARTITION BY subreddit ORDER BY upvotes DESC, post_id)::INT AS rank FROM posts QUALIFY rank <= 10")
_add("u1_union_of_sources", lambda p: p.where("tier = 't1'").select("post_id").union(p.where("upvotes > 20").select("post_id")).distinct(), "SELECT post_id FROM posts WHERE tier = 't1' UNION SELECT post_id FROM posts WHERE upvotes > 20")
_add("u4_unseen_ids", lambda p: p.select("post_id").join(p.where("tier = 't1'").select("post_id"), "post_id", "left_anti"), "SELECT post_id FROM posts WHERE tier <> 't1'")

# ---------------------------------------------------------------- mining and validation
_TH = "th AS (SELECT quantile_cont(upvotes, {0}) AS threshold FROM f)"
_CL = "cl AS (SELECT tier, hook, narrative, content_type, count(*) FILTER (upvotes >= threshold) AS viral, count(*) AS n, avg(upvotes) AS avg_upvotes, (count(*) FILTER (upvotes >= threshold))::DOUBLE / count(*) AS rate FROM f, th GROUP BY ALL)"
_add("a42_clusters", lambda p: M.clusters(M.features(p)), f"WITH {_FEAT}, {_TH.format(0.9)}, {_CL} SELECT tier, hook, narrative, content_type, viral, n, avg_upvotes, rate FROM cl")
_CHI = "x AS (SELECT cl.*, av, an, viral::DOUBLE AS a, (n - viral)::DOUBLE AS b, (av - viral)::DOUBLE AS c, (an - n - av + viral)::DOUBLE AS d FROM cl, (SELECT sum(viral)::BIGINT AS av, sum(n)::BIGINT AS an FROM cl) WHERE n >= 10 AND viral >= 5), y AS (SELECT *, CASE WHEN (a+b)*(c+d)*(a+c)*(b+d) <= 0 THEN 0.0 ELSE (a+b+c+d) * greatest(abs(a*d - b*c) - (a+b+c+d) / 2, 0.0) * greatest(abs(a*d - b*c) - (a+b+c+d) / 2, 0.0) / ((a+b)*(c+d)*(a+c)*(b+d)) END AS chi2 FROM x)"
_add("a43_patterns", lambda p: M.over_represented(M.features(p)), f"WITH {_FEAT}, {_TH.format(0.9)}, {_CL}, {_CHI} SELECT tier, hook, narrative, content_type, viral, n, rate, chi2 FROM y WHERE chi2 >= 3.841459 AND viral * an > av * n AND an >= 30 AND av >= 10 ORDER BY rate * ln(n) DESC, tier, hook, narrative, content_type LIMIT 8")
_BUCKET = "CASE WHEN title_words < 5 THEN 'very_short_title' WHEN title_words > 30 THEN 'very_long_title' WHEN body_words = 0 THEN 'no_body_text' WHEN body_words > 1000 THEN 'very_long_body' ELSE 'generic_low_engagement' END"
_add("a47_anti_patterns", lambda p: M.anti_patterns(M.features(p)).withColumn("exemplars", F.array_join("exemplars", ",")), f"WITH {_FEAT}, m AS (SELECT quantile_cont(upvotes, 0.9) AS t, median(upvotes)::DOUBLE AS md FROM f), b AS (SELECT *, {_BUCKET} AS bucket, row_number() OVER (PARTITION BY {_BUCKET} ORDER BY doc_id) AS i FROM f, m WHERE upvotes < t) SELECT bucket, count(*) AS n, (count(*) FILTER (upvotes < md))::DOUBLE / count(*) AS failure_rate, string_agg(post_id, ',' ORDER BY i) FILTER (i <= 3) AS exemplars FROM b GROUP BY 1 HAVING count(*) >= 10 AND (SELECT count(*) FROM b) >= 10")
_add("a49_target_encoding", lambda p: M.target_encoding(p), "WITH t AS (SELECT subreddit, quantile_cont(upvotes, 0.75) AS threshold FROM posts GROUP BY 1) SELECT subreddit, threshold, count(*) AS n, (count(*) FILTER (upvotes >= threshold))::DOUBLE / count(*) AS viral_rate FROM posts JOIN t USING (subreddit) GROUP BY subreddit, threshold")
_add("c3_backtest", lambda p: M.backtest(p, "2024-01-15"), None)
_add("w8_random_split", lambda p: M.random_split(p).select("post_id", "split"), "SELECT post_id, CASE WHEN row_number() OVER (PARTITION BY subreddit ORDER BY md5(post_id || '-42'), post_id) <= greatest(1, floor(count(*) OVER (PARTITION BY subreddit) * 3 / 5)) THEN 'train' ELSE 'test' END AS split FROM posts")

# ---------------------------------------------------------------- feedback
_MED = "med AS (SELECT subreddit, median(actual_upvotes)::DOUBLE AS median FROM feedback WHERE actual_upvotes > 0 GROUP BY 1)"
_CLS = _MED + ", fb AS (SELECT f.*, coalesce(median, 50.0) AS median, CASE WHEN coalesce(median, 50.0) <= 0 THEN CASE WHEN actual_upvotes > 0 THEN 'passing' ELSE 'failed' END WHEN actual_upvotes / coalesce(median, 50.0) >= 10 THEN 'super_viral' WHEN actual_upvotes / coalesce(median, 50.0) >= 3 THEN 'viral' WHEN actual_upvotes / coalesce(median, 50.0) >= 1.5 THEN 'passing' ELSE 'failed' END AS performance FROM feedback f LEFT JOIN med USING (subreddit))"
_classified = lambda f: B.classified(f, B.community_medians(f, "actual_upvotes"))
_add_f("a50_community_medians", lambda f: B.community_medians(f, "actual_upvotes"), f"WITH {_MED} SELECT subreddit, median FROM med")
_add_f("j9_classified_feedback", lambda f: _classified(f).select("event_id", "median", "performance"), f"WITH {_CLS} SELECT event_id, median, performance FROM fb")
_add_f("a51_success_rates", lambda f: B.success_rates(_classified(f)), f"WITH {_CLS} SELECT pattern_id, count(*) AS n, (count(*) FILTER (performance <> 'failed'))::DOUBLE / count(*) AS success_rate FROM fb GROUP BY 1")
_add_f("a52_failure_streaks", lambda f: B.streaks(_classified(f)), f"WITH {_CLS}, r AS (SELECT pattern_id, performance, row_number() OVER (PARTITION BY pattern_id ORDER BY tracked_at DESC, event_id DESC) AS i FROM fb), s AS (SELECT pattern_id, coalesce(min(i) FILTER (performance <> 'failed') - 1, count(*)) AS streak FROM r GROUP BY 1) SELECT pattern_id, streak, CASE WHEN streak >= 10 THEN 'inactive' ELSE 'active' END AS status FROM s")
_add_f("a53_dashboard", lambda f: B.dashboard(_classified(f)), f"""WITH {_CLS}, fp AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tracked_at DESC, event_id DESC) AS i FROM fb WHERE actual_upvotes > 0), p AS (SELECT user_id, subreddit, count(*) AS n, sum(actual_upvotes)::BIGINT AS s, max(actual_upvotes) AS m, count(*) FILTER (performance <> 'failed') AS k FROM fp GROUP BY ALL),
b AS (SELECT user_id, subreddit FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s::DOUBLE / n DESC, subreddit DESC) = 1), r AS (SELECT user_id, string_agg(subreddit || ':' || actual_upvotes || ':' || performance, ' ' ORDER BY i) AS recent FROM fp WHERE i <= 5 GROUP BY 1)
SELECT user_id, sum(n)::BIGINT AS n, sum(s)::BIGINT AS total, sum(s)::DOUBLE / sum(n)::DOUBLE AS avg_upvotes, sum(k)::DOUBLE / sum(n)::DOUBLE AS survival, any_value(b.subreddit) AS best_subreddit, len(list_filter([25, 50, 100, 250, 500, 1000], lambda x: x <= max(m)))::BIGINT AS milestones, any_value(recent) AS recent FROM p JOIN b USING (user_id) JOIN r USING (user_id) GROUP BY user_id""")
_add_f("a55_best_times", lambda f: B.best_times(f, {"src3": (("Monday", "14:00-17:00 UTC", 80), ("Saturday", "10:00-14:00 UTC", 79))}), """WITH d(sub, day, slot, base, i) AS (VALUES ('src3', 'Monday', '14:00-17:00 UTC', 80, 0), ('src3', 'Saturday', '10:00-14:00 UTC', 79, 1), (NULL, 'Tuesday', '14:00-17:00 UTC', 70, 0), (NULL, 'Wednesday', '13:00-16:00 UTC', 68, 1), (NULL, 'Thursday', '15:00-18:00 UTC', 65, 2)),
u AS (SELECT user_id, subreddit, count(*) FILTER (actual_upvotes > 0) AS n FROM feedback GROUP BY ALL), p AS (SELECT user_id, subreddit, strftime(tracked_at, '%A') AS day, avg(actual_upvotes) AS a FROM feedback WHERE actual_upvotes > 0 GROUP BY ALL),
s AS (SELECT u.user_id, u.subreddit, d.day, slot, i, CASE WHEN n >= 5 AND a IS NOT NULL THEN least(99, base + least(20, floor(a / 5)))::BIGINT ELSE base END AS score FROM u JOIN d ON d.sub = u.subreddit OR (d.sub IS NULL AND u.subreddit <> 'src3') LEFT JOIN p ON p.user_id = u.user_id AND p.subreddit = u.subreddit AND p.day = d.day)
SELECT user_id, subreddit, day, slot AS "window", score, row_number() OVER (PARTITION BY user_id, subreddit ORDER BY score DESC, i)::INT AS rank FROM s""")
