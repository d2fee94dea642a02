"""Checks of drafts, reasons of failed posts, and parsing of model output, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tractionlens.functions import text as T

# Phrases that show each hook type in a title or the start of a body.
HOOK_SIGNALS: dict[str, tuple[str, ...]] = {
    "tutorial_howto": ("how to", "guide", "step", "learn", "tutorial"),
    "story_opener": ("i ", "my ", "journey", "experience", "learned", "year"),
    "resource_share": ("i built", "i made", "i created", "tool", "app", "resource", "share"),
    "curious_question": ("?", "why ", "how does", "anyone", "question"),
    "counterintuitive_discovery": ("discovered", "unexpected", "changed", "surprising", "found"),
    "controversial_opinion": ("unpopular", "opinion", "controversial", "unlike"),
    "pain_point": ("problem", "struggle", "frustration", "hard", "difficult", "nobody"),
    "comparison_analysis": ("vs", "versus", "compared", "better", "worse", "differ"),
    "identity_label": ("as a", "as an", "developer", "engineer", "founder"),
    "number_shock": (*map(str, range(1, 100)), "percent", "%"),
}
# Phrases of posts that ask for nothing in particular.
GENERIC = ("just wanted to say", "what do you think", "anyone else")
# What to do about each weak dimension.
ACTIONS = {"title": "sharpen the title", "body": "adjust the body", "quality": "add substance", "pattern": "take a pattern with a higher rate"}


def hook_presence(title: Column, body: Column, hook: Column) -> Column:
    """100 for three or more signals of the hook in the title and the first 200 characters of the body, 60 for one, else 25."""
    low = F.lower(F.concat(title, F.lit(" "), F.substring(body, 1, 200)))
    found = F.lit(0)
    for name, words in HOOK_SIGNALS.items():
        found = F.when(hook == name, T.hits(low, words, lowered=True)).otherwise(found)
    return F.transform(F.array(found), lambda n: F.when(n >= 3, 100).when(n >= 1, 60).otherwise(25))[0]


def title_check(title: Column, hook: Column) -> Column:
    """struct(words, hook, anti, overall) of a title alone: 0.3 length, 0.4 hook, 0.3 freedom from anti-patterns."""
    n = T.n_words(title)
    size = F.when(n.between(5, 25), 100).when(n.between(3, 30), 70).otherwise(30)
    bad = (n < 5).cast("int") + (n > 30).cast("int") + T.has_any(F.lower(title), GENERIC).cast("int")
    anti = F.greatest(F.lit(0), 100 - bad * 30)
    presence = hook_presence(title, F.lit(""), hook)
    overall = F.round((size * 3 + presence * 4 + anti * 3).cast("double") / 10, 1)
    return F.struct(size.alias("words"), presence.alias("hook"), anti.alias("anti"), overall.alias("overall"))


def draft_check(title: Column, body: Column, hook: Column, t_lo: Column, t_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Five scores of a draft against a pattern's hook and ranges, its suggestions, and whether it passes: the title is within
    three words of its range and no anti-pattern occurs. Null title or body counts as empty."""
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    shown = F.when((hook == "") | (body == ""), 80).otherwise(hook_presence(title, body, hook))
    blank, generic = F.length(F.trim(body)) < 10, T.has_any(F.lower(F.concat(title, body)), GENERIC)
    # what reads the texts is bound, so each text is scanned once and not once for every score that names it
    read = {"n": T.n_words(title), "m": T.n_words(body), "ease": T.readability(body)["ease"], "shown": shown, "blank": blank, "generic": generic}

    def checked(x: Column) -> Column:
        n, m, ease, shown = (x[k] for k in ("n", "m", "ease", "shown"))
        near = (F.abs(n - t_lo) <= 3) | (F.abs(n - t_hi) <= 3)
        in_title = F.when(n.between(t_lo, t_hi), 100).when(near, 70).otherwise(30)
        in_body = F.when((m == 0) | m.between(b_lo, b_hi), 100).when((b_hi <= 1) & (m <= 1), 100).when(m < b_lo, 50).otherwise(40)
        readable = F.when(m < 20, 100).when(ease.between(50, 85), 100).when(ease.between(40, 90), 70).otherwise(40)
        anti = {"short title": n < 5, "long title": n > 30, "no body": (b_hi > 1) & x["blank"], "generic": x["generic"] & (m < 50)}
        bad = F.array_compact(F.array(*[F.when(test, name) for name, test in anti.items()]))
        free = F.greatest(F.lit(0), 100 - F.size(bad) * 30)
        advice = [F.when(score < least, text) for score, least, text in ((in_title, 100, "title length"), (in_body, 100, "body length"), (readable, 100, "readability"), (shown, 50, "hook"))]
        scores = {"title_length": in_title, "body_length": in_body, "readability": readable, "hook": shown, "anti": free}
        passed = (in_title > 30) & (F.size(bad) == 0)
        return F.struct(*[v.alias(k) for k, v in scores.items()], F.concat(F.array_compact(F.array(*advice)), bad).alias("suggestions"), passed.alias("passed"))

    return T.bound(F.struct(*[v.alias(k) for k, v in read.items()]), checked)


def attribution(title: Column, body: Column, ratio: Column, pattern_rate: Column) -> Column:
    """Why a post failed: the weakest dimension under 50 (`primary`), the next two, up to three actions, and a confidence of
    100 less the mean score within 20 to 90. Time and topic count 60 each; a pattern only where its rate (percent) is below 20."""
    counts = F.struct(T.n_words(F.coalesce(title, F.lit(""))).alias("n"), T.n_words(F.coalesce(body, F.lit(""))).alias("m"), ratio.alias("ratio"), pattern_rate.alias("rate"))
    return T.bound(counts, lambda x: _reasons(x["n"], x["m"], x["ratio"], x["rate"]))


def _reasons(n: Column, m: Column, ratio: Column, pattern_rate: Column) -> Column:
    """attribution() from the words of title and body."""
    scores = {
        "title": F.when(n < 5, 20).when(n > 30, 30).otherwise(70),
        "body": F.when(m < 20, 20).when(m > 1000, 30).otherwise(70),
        "quality": F.when((ratio > 0) & (ratio < 0.5), 20).when(ratio >= 0.7, 75).otherwise(50),
        "pattern": F.when(pattern_rate < 20, 25),
    }
    weak = [F.when(s < 50, F.struct(s.alias("score"), F.lit(i).alias("i"), F.lit(k).alias("dimension"))) for i, (k, s) in enumerate(scores.items())]
    names = F.transform(F.array_sort(F.array_compact(F.array(*weak))), lambda w: w["dimension"])
    todo = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    actions = F.when(F.size(names) == 0, F.array(F.lit("take another pattern or community"))).otherwise(F.transform(F.slice(names, 1, 3), lambda k: todo[k]))
    counted = 5 + F.when(pattern_rate < 20, 1).otherwise(0)
    total = scores["title"] + scores["body"] + scores["quality"] + 120 + F.coalesce(scores["pattern"], F.lit(0))
    confidence = F.least(F.lit(90.0), F.greatest(F.lit(20.0), 100 - total.cast("double") / counted))
    return F.struct(F.get(names, 0).alias("primary"), F.slice(names, 2, 2).alias("secondary"), actions.alias("actions"), confidence.alias("confidence"))


def numbered_labels(response: Column, categories: list[str]) -> Column:
    """The labels of lines `N: label`: the first category that holds the label or is held by it, else the first of all."""
    lines = F.filter(F.transform(F.split(F.trim(response), "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[0-9]+[:.)]\s*\S"))
    labels = F.transform(lines, lambda x: F.btrim(F.lower(F.regexp_extract(x, r"^[0-9]+[:.)]\s*(\S+)", 1)), F.lit(".,;:!?\"'")))
    known = F.array(*[F.lit(k) for k in categories])
    fit = lambda x: F.get(F.filter(known, lambda k: F.contains(x, F.lower(k)) | F.contains(F.lower(k), x)), 0)
    return F.transform(labels, lambda x: F.coalesce(fit(x), F.lit(categories[0])))


def json_text(raw: Column) -> Column:
    """The JSON in a model's answer: the whole, else the first fenced part, else from the first brace to the last; else null."""
    whole = F.trim(raw)
    tries = (whole, F.trim(F.regexp_extract(whole, r"(?s)```(?:json)?\s*(.*?)```", 1)), F.regexp_extract(whole, r"(?s)\{.*\}", 0))
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull(), x) for x in tries])
