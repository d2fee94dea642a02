"""Text features as Column builders; lexicons are parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lexicons and word lists below decide results and must stay as they are.
#: Hook categories in declared order, which breaks ties; keywords are matched as substrings of the lower-cased text.
HOOKS: dict[str, tuple[str, ...]] = {
    "counterintuitive_discovery": ("discovered", "i found", "changed everything", "i realized", "secret", "no one tells", "nobody tells"),
    "suspense_mystery": ("you won't believe", "what happened next", "wait until", "plot twist", "unexpected"),
    "pain_point": ("sick of", "tired of", "frustrated", "hate", "worst", "problem with", "annoying", "struggle"),
    "identity_label": ("as a", "if you're a", "anyone else", "fellow", "we all"),
    "number_shock": ("things", "ways", "reasons", "tips", "secrets", "lessons", "rules", "$", "%", "times"),
    "story_opener": ("my journey", "my experience", "i spent", "after years", "i finally", "i built"),
    "resource_share": ("resource", "free", "tool", "template", "open source", "i made", "i created", "check out"),
    "controversial_opinion": ("unpopular opinion", "hot take", "controversial", "change my mind", "i don't care"),
    "comparison_analysis": (" vs ", " versus ", "compared to", "difference between", "better than"),
    "curious_question": ("why does", "how does", "what is", "eli5", "can someone", "anyone know", "has anyone"),
}
POSITIVE = ("good", "great", "best", "amazing", "love", "awesome", "beautiful", "perfect", "thank", "win", "success", "happy", "wow", "incredible", "fantastic", "finally")
NEGATIVE = ("bad", "worst", "hate", "terrible", "awful", "sucks", "horrible", "fail", "death", "never", "wrong", "ugly", "boring", "disappointed", "frustrated", "problem")
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "shall", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before",
    "after", "above", "below", "between", "and", "but", "or", "nor", "not", "so", "yet", "both", "either", "neither", "each", "every", "all", "any",
    "few", "more", "most", "other", "some", "such", "no", "only", "own", "same", "than", "too", "very", "just", "about", "also", "if", "then", "else",
    "this", "that", "these", "those", "it", "its", "i", "me", "my", "we", "our", "you", "your", "he", "she", "they", "him", "his", "her", "them",
    "what", "which", "who", "whom", "when", "where", "why", "how", "am", "don", "didn", "doesn", "isn", "aren", "wasn", "weren", "haven", "hasn",
    "hadn", "won", "wouldn", "couldn",
)
#: Narrative modes of a body by keywords, in the order of the rules; and what a personal story holds.
TUTORIAL = ("step 1", "how to", "tutorial", "guide", "here's how")
OPINION = ("i think", "in my opinion", "unpopular", "should be")
SHOWCASE = ("i built", "i made", "i created", "check out my", "github.com")
PERSONAL = ("i ", "my ", "me ", "we ")
#: Opening patterns of a body's first sentence, in the order of the rules.
OPENINGS: dict[str, tuple[str, ...]] = {
    "personal_intro": ("i am", "i'm", "my name", "a bit about"),
    "hook_first": ("i discovered", "you won't believe", "this changed", "imagine"),
    "conflict_first": ("the problem", "i was struggling", "i was frustrated"),
    "direct_answer": ("here's", "let me", "first", "to start"),
    "quote_reference": ("according to", "as ["),
}
CLICKBAIT = ("you won't believe", "mind blown", "this one trick", "doctors hate", "shocking truth", "???")
#: What topic words make a hook fit a request.
HOOK_TOPICS: dict[str, tuple[str, ...]] = {
    "tutorial_howto": ("how", "guide", "tutorial", "build", "made", "created", "script", "tool"),
    "resource_share": ("tool", "resource", "free", "build", "made", "created", "app"),
    "story_opener": ("journey", "story", "experience", "year", "month", "learned"),
    "curious_question": ("why", "how", "question", "anyone", "else"),
    "counterintuitive_discovery": ("discovered", "found", "changed", "unexpected", "surprising"),
    "controversial_opinion": ("opinion", "unpopular", "hot", "take", "controversial"),
    "pain_point": ("problem", "struggle", "frustration", "hard", "difficult", "fail"),
    "comparison_analysis": ("vs", "compar", "versus", "differ", "better", "best"),
    "identity_label": ("as a", "developer", "engineer", "founder", "student", "parent"),
    "number_shock": ("number", "stat", "percent", "million", "thousand"),
    "suspense_mystery": ("secret", "nobody", "hidden", "mystery", "unknown"),
}
#: Flairs by priority with the topic words that call for them.
FLAIRS: dict[str, tuple[str, ...]] = {
    "Resource": ("tool", "resource", "build", "made", "app", "script", "guide", "template"),
    "Tutorial": ("tutorial", "guide", "how to", "learn", "step"),
    "I made this": ("build", "made", "created", "launched", "my", "project", "app"),
    "Guide": ("guide", "tutorial", "walkthrough", "setup"),
    "Story": ("journey", "story", "experience", "learned", "year"),
    "Advice": ("advice", "tip", "suggestion", "help", "question"),
    "Discussion": ("discuss", "think", "opinion", "thought"),
    "Question": ("question", "anyone", "help", "how do", "why"),
}
#: What calls the reader to answer.
CALLS = ("let me know", "what do you think", "share your", "would love to hear", "comments below", "thoughts?", "agree?", "discuss")
#: Words that tie a title to the present.
TIME_WORDS = ("today", "just", "finally", "now", "yesterday", "tonight", "this week", "this month", "this year", "breaking", "update", "latest", "new")
ENGAGING = ("thoughts", "feedback", "experience", "let me know", "would love")
MEDIA_ALIASES = {"text": "text", "self": "text", "image": "image", "img": "image", "photo": "image", "video": "video", "gif": "video", "link": "link", "url": "link", "poll": "poll"}
# End of the fixed values.


WHITE = " \t\n\r\f\v"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\s]+")).cast("long")


def n_sentences(text: Column) -> Column:
    """Parts between runs of `.!?` that hold more than spaces."""
    return F.regexp_count(text, F.lit(r"[^ .!?][^.!?]*+")).cast("long")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often `use` names it: a one-element array binds it."""
    return F.transform(F.array(value), use)[0]


def hits(text: Column, words: tuple[str, ...], lowered: bool = False) -> Column:
    """How many of the words occur, as substrings of the lower-cased text."""
    low = text if lowered else F.lower(text)
    total = F.lit(0)
    for w in words:
        total = total + F.contains(low, F.lit(w)).cast("int")
    return total


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-cased text holds one of the words as a substring."""
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def hook_type(text: Column, lexicon: dict[str, tuple[str, ...]] = HOOKS) -> Column:
    """Structure first (a question without a digit, a comparison, a how-to), then the category with most keywords, then a
    number, a story, a question."""
    low, number = F.lower(text), text.rlike("[0-9]")
    names = F.array(*[F.lit(k) for k in lexicon])
    first = lambda s: F.when(F.array_max(s) > 0, F.element_at(names, F.array_position(s, F.array_max(s)).cast("int")))
    # one-element arrays bind the lower-cased text and the scores, so each is worked out once
    scores = F.transform(F.array(low), lambda x: F.array(*[hits(x, v, lowered=True) for v in lexicon.values()]))
    out = F.when(F.contains(text, F.lit("?")) & ~number, "curious_question").when(has_any(low, (" vs ", " versus ")), "comparison_analysis")
    out = out.when(F.contains(F.substring(low, 1, 30), F.lit("how to")), "tutorial_howto").otherwise(F.transform(scores, first)[0])
    story = low.rlike(r"(^|[^\p{L}\p{N}_])i($|[^\p{L}\p{N}_])") & (F.length(text) > 50)
    return F.coalesce(out, F.when(number, "number_shock").when(story, "story_opener").otherwise("curious_question"))


def narrative_mode(body: Column, story_first: bool = False, with_no_body: bool = True) -> Column:
    """Mode by keywords, then question and story in an order that is a parameter, else an opinion."""
    low = F.lower(body)
    question = F.endswith(F.rtrim(body), F.lit("?")) | F.contains(low, F.lit("anyone else"))
    story = has_any(low, PERSONAL) & (F.length(body) > 200)
    out = F.when(F.length(body) < 20, "no_body") if with_no_body else F.when(F.lit(False), "")
    out = out.when(has_any(low, TUTORIAL), "tutorial_howto").when(has_any(low, OPINION), "opinion_argument").when(has_any(low, SHOWCASE), "resource_showcase")
    both = (("story_personal", story), ("question_discussion", question))
    for name, test in both if story_first else both[::-1]:
        out = out.when(test, name)
    return out.otherwise("opinion_argument")


def opening(body: Column) -> Column:
    """The pattern of the first sentence within the first 200 characters."""
    first = F.lower(F.substring_index(F.substring(body, 1, 200), ".", 1))
    out = F.when(F.endswith(first, F.lit("?")), "rhetorical_question")
    for name, words in OPENINGS.items():
        out = out.when(has_any(first, words), name)
    return out.otherwise("background_first")


def polarity(text: Column) -> Column:
    p, n = hits(text, POSITIVE), hits(text, NEGATIVE)
    return F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")


def intensity(text: Column) -> Column:
    """A fifth of the hits of the side that has more, at most 1; 0.3 where neither has."""
    p, n = hits(text, POSITIVE), hits(text, NEGATIVE)
    return F.when(p == n, 0.3).otherwise(F.least(F.greatest(p, n) / 5, F.lit(1.0)))


def syllables(word: Column) -> Column:
    w = F.lower(word)
    return F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")) - F.endswith(w, F.lit("e")).cast("int"))


def performance(upvotes: Column, median: Column) -> Column:
    """Class by the ratio to the community's median: 10, 3 and 1.5 times; with no median any score passes."""
    ratio = upvotes / F.nullif(median, F.lit(0))
    return F.when(median <= 0, F.when(upvotes > 0, "passing").otherwise("failed")).when(ratio >= 10, "super_viral").when(ratio >= 3, "viral").when(ratio >= 1.5, "passing").otherwise("failed")


def milestones(old: Column, new: Column, levels: tuple[int, ...] = (25, 50, 100, 250, 500, 1000)) -> Column:
    return F.filter(F.array(*[F.lit(x).cast("long") for x in levels]), lambda m: (old < m) & (m <= new))


def paragraphs(body: Column) -> Column:
    """Blank-line breaks plus one; 0 for an empty body."""
    return F.when(F.trim(body) == "", 0).otherwise(F.regexp_count(body, F.lit("\n\n")) + 1).cast("long")


def text_syllables(low: Column) -> Column:
    """The sum of syllables() over the words of a lower-cased text, each without `.:;?!` at its ends, by three scans of the
    whole text and no step per word: vowel groups, less words that end with an e, plus one for words that this leaves at none."""
    ends_with_e = F.regexp_count(low, F.lit(r"e[.:;?!]*+(?!\S)"))
    at_none = F.regexp_count(low, F.lit(r"(?<!\S)(?=\S)[^\saeiouy]*+(?:[aeiouy]++(?<=e)[.:;?!]*+)?(?!\S)"))
    return F.regexp_count(low, F.lit("[aeiouy]+")) - ends_with_e + at_none


def readability(body: Column) -> Column:
    """struct(grade, ease): Flesch-Kincaid grade from 0 on and reading ease within 0 to 100; 0 without a word or sentence."""
    counts = F.struct(n_words(body).alias("n"), n_sentences(body).alias("sentences"), text_syllables(F.lower(body)).alias("total"))

    def scores(x: Column) -> Column:
        length, sounds = x["n"] / x["sentences"], x["total"] / x["n"]
        some = (x["n"] > 0) & (x["sentences"] > 0)
        grade = F.when(some, F.greatest(F.lit(0.0), 0.39 * length + 11.8 * sounds - 15.59)).otherwise(0.0)
        ease = F.when(some, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * length - 84.6 * sounds))).otherwise(0.0)
        return F.struct(grade.alias("grade"), ease.alias("ease"))

    return bound(counts, scores)


def media(alias: Column) -> Column:
    """A media type from its aliases; text for others."""
    low = F.trim(F.lower(alias))
    out = F.lit("text")
    for name, kind in MEDIA_ALIASES.items():
        out = F.when(low == name, kind).otherwise(out)
    return out


def tier_of(subscribers: Column) -> Column:
    return F.when(subscribers >= 20_000_000, "t1").when(subscribers >= 1_000_000, "t2").otherwise("t3")


def title_score(title: Column, low: Column, high: Column) -> Column:
    """0 to 100: range fit, clickbait, punctuation, a capital first, length. An empty title has no capital."""
    n = n_words(title)
    fit = F.when(n.between(low, high), 30).when((F.abs(n - low) <= 3) | (F.abs(n - high) <= 3), 15).otherwise(0)
    bait = hits(title, CLICKBAIT) * 10
    marks = F.when(F.regexp_count(title, F.lit("!")) > 1, 5).otherwise(0) + F.when(F.regexp_count(title, F.lit("\\?")) > 1, 3).otherwise(0)
    capital = F.when(title.rlike(r"^\p{Lu}"), 10).otherwise(0)
    size = F.when(n < 3, 20).when(n > 50, 15).otherwise(0)
    return F.least(F.lit(100), F.greatest(F.lit(0), 50 + fit - bait - marks + capital - size)).cast("long")


def flair(topic: Column, flairs: dict[str, tuple[str, ...]] = FLAIRS) -> Column:
    """The first flair by priority that the topic calls for, else null."""
    low, out = F.lower(topic), F.lit(None).cast("string")
    for name, words in reversed(flairs.items()):
        out = F.when(has_any(low, words), name).otherwise(out)
    return out


def engaging(body: Column) -> Column:
    """Whether the last sentence asks or calls for an answer."""
    last = F.trim(F.element_at(F.split(F.trim(body), "[.]"), -1))
    return F.contains(last, F.lit("?")) | has_any(F.lower(last), ENGAGING)


def calls_to_answer(body: Column) -> Column:
    """Whether a body ends with a question or calls for an answer anywhere."""
    return F.endswith(stripped(body), F.lit("?")) | has_any(F.lower(body), CALLS)


def letter_words(text: Column) -> Column:
    """The lower-cased words of three letters on, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1))


def tokens(text: Column) -> Column:
    """The distinct lower-cased words of three letters on, and adjacent pairs of them joined, in order of the alphabet."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1))
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.concat(a, b))
    return F.array_sort(F.array_distinct(F.concat(words, pairs)))


def request_words(text: Column, most: int = 15) -> Column:
    """The first `most` keywords of a request: runs of two or more CJK characters, then words of three letters on that are no
    stop words. Words may repeat."""
    han = F.regexp_extract_all(text, F.lit("([\u4e00-\u9fff\u3400-\u4dbf]{2,})"), F.lit(1))
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1)), lambda w: ~w.isin(*STOP_WORDS))
    return F.slice(F.concat(han, words), 1, most)
