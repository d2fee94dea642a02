"""Queries of the analysis of all levels with their SQL, written per measure; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractionlens.functions import text as T
from tractionlens.operators import fanout as N
from tractionlens.plans.intervals import _t_tails
from tractionlens.plans.more import _READ
from tractionlens.plans.registry import _BFLAGS, _BW, _DEV, _FLAGS, _N, _NARRATIVE, _OPENING, _P, _POLARITY, _SLOTS, _TW, _add, _any, _hook

c = F.col
_CAPS = "(upper(title) = title AND lower(title) <> title)"
#: Part -> condition, numbers, flags, classes.
_MEASURES = {
    "title": (
        "title <> ''",
        {"char_count": "length(title)", "word_count": _TW, "intensity": f"round(CASE WHEN {_P} = {_N} THEN 0.3 ELSE least(greatest({_P}, {_N}) / 5, 1.0) END * 10)"},
        _FLAGS | {"all_caps": f"{_CAPS} AND length(title) > 10", "mixed_case": rf"regexp_matches(title, '\p{{Lu}}') AND NOT {_CAPS}", "temporal": _any("title", T.TIME_WORDS)},
        {"hook": _hook("title"), "polarity": _POLARITY, "structure": " || '|' || ".join(f"CASE WHEN {v} THEN '{k}' ELSE '' END" for k, v in _SLOTS.items())},
    ),
    "body": (
        "length(body) >= 20",
        {"word_count": _BW, "paragraph_count": r"len(regexp_extract_all(body, '\n\n')) + 1", "grade": "round(grade * 100)", "ease": "round(ease * 100)"},
        _BFLAGS | {"engaging": f"({_BFLAGS['ending_question']} OR {_BFLAGS['call_to_action']})"},
        {"narrative": _NARRATIVE, "opening": _OPENING.format("lower(string_split(substring(body, 1, 200), '.')[1])")},
    ),
    "meta": (
        "TRUE",
        {},
        {"flaired": "coalesce(flair, '') <> ''", "controversial": "upvote_ratio > 0 AND upvote_ratio < 0.75 AND num_comments > 0"},
        {"flair": "CASE WHEN flair <> '' THEN lower(flair) END", "media": "content_type", "day": "strftime(created_utc, '%a')", "hour": "strftime(created_utc, '%H')"},
    ),
}


def _analysis() -> str:
    # each measure is a column of one wide table, null where a post takes no part
    columns = ", ".join(f"CASE WHEN {test} THEN ({sql}){kind} END AS {part}_{name}" for part, (test, numbers, flags, classes) in _MEASURES.items() for group, kind in ((numbers, "::BIGINT"), (flags, "::INT"), (classes, "")) for name, sql in group.items())
    out = []
    row = lambda part, name, value, statistic, amount: f"SELECT level, key, '{part}' AS part, '{name}' AS measure, {value} AS value, '{statistic}' AS statistic, {amount} AS amount"
    corr = lambda x, y: f"CASE WHEN count({x}) < 10 THEN 0.0 ELSE coalesce(CASE WHEN isnan(corr({x}, {y})) THEN 0 ELSE corr({x}, {y}) END, 0.0) END"
    for part, (_, numbers, flags, classes) in _MEASURES.items():
        for name in numbers:
            x = f"{part}_{name}"
            rows = {"n": f"count({x})", "mean": f"avg({x})", "std": f"stddev_pop({x})", **{f"p{round(q * 100)}": f"quantile_cont({x}, {q})" for q in N.QUANTILES}, "r": corr(x, "upvotes")}
            out += [row(part, name, "NULL", k, v) + f" FROM lv WHERE {x} IS NOT NULL GROUP BY ALL" for k, v in rows.items()]
            out.append(row(part, name, "NULL", "p", _t_tails("r", "n")) + f" FROM (SELECT level, key, count({x}) AS n, {corr(x, 'upvotes')} AS r FROM lv WHERE {x} IS NOT NULL GROUP BY ALL)")
        for name in flags:
            x = f"{part}_{name}"
            rows = {"n": f"count({x})", "rate": f"avg({x})", "gain": f"coalesce(avg(upvotes) FILTER ({x} = 1) - avg(upvotes) FILTER ({x} = 0), 0.0)"}
            out += [row(part, name, "NULL", k, v) + f" FROM lv WHERE {x} IS NOT NULL GROUP BY ALL" for k, v in rows.items()]
        for name in classes:
            x = f"{part}_{name}"
            rows = {"n": "count(*)", "share": "count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY level, key)", "avg_upvotes": "avg(upvotes)", "std": _DEV.format("upvotes")}
            out += [row(part, name, x, k, v) + f" FROM lv WHERE {x} IS NOT NULL GROUP BY level, key, {x}" for k, v in rows.items()]
    r = corr("body_engaging", "num_comments")
    out += [row("body", "engaging", "NULL", "r", r) + " FROM lv WHERE body_engaging IS NOT NULL GROUP BY ALL", row("body", "engaging", "NULL", "p", _t_tails("r", "n")) + f" FROM (SELECT level, key, count(body_engaging) AS n, {r} AS r FROM lv WHERE body_engaging IS NOT NULL GROUP BY ALL)"]
    union = " UNION ALL ".join(out)
    return f"WITH {_READ}, wide AS (SELECT posts.tier, posts.subreddit, posts.upvotes, posts.num_comments, {columns} FROM posts JOIN rd USING (post_id)), lv AS (SELECT 'all' AS level, 'all' AS key, * FROM wide UNION ALL SELECT 'tier', tier, * FROM wide UNION ALL SELECT 'subreddit', lower(subreddit), * FROM wide) SELECT level, key, part, measure, coalesce(value, '') AS value, statistic, round(amount, 8) + 0.0 AS amount FROM ({union})"


_add("c2_analysis", lambda p: N.analyzed(p).select("level", "key", "part", "measure", F.coalesce("value", F.lit("")).alias("value"), "statistic", (F.round("amount", 8) + 0.0).alias("amount")), _analysis())
