"""Validation of mined patterns: held-out communities, transfer between tiers, threshold sweeps, boosted trees."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractionlens.functions import text as T
from tractionlens.operators import mining as M
from tractionlens.sources.storage import written

NUMBERS = ("title_words", "body_words", "title_chars", "body_chars", "ratio", "grade", "ease", "hour_sin", "hour_cos", "day_sin", "day_cos", "weekend", "is_text", "is_image", "is_video", "is_link", "is_t1", "is_t2", "is_t3", "viral_rate", "hook_index", "narrative_index", "question", "number", "exclamation", "caps", "starts_how", "starts_why", "exclamations", "url", "code", "paragraphs", "bold", "list")
_MODES = ("no_body", "tutorial_howto", "opinion_argument", "resource_showcase", "question_discussion", "story_personal")


def holdout_communities(df: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """One community of t1, one of t3, and others up to `n`, by the hash of the name: (subreddit, tier)."""
    names = df.groupBy(F.lower("subreddit").alias("subreddit")).agg(F.min("tier").alias("tier"))
    names = names.withColumn("_h", F.md5(F.concat_ws("-", "subreddit", F.lit(seed)).cast("binary")))
    first = F.row_number().over(W.partitionBy("tier").orderBy("_h", "subreddit"))
    names = names.withColumn("_first", F.when((first == 1) & F.col("tier").isin("t1", "t3"), 0).otherwise(1))
    return names.orderBy("_first", "_h", "subreddit").limit(n).select("subreddit", "tier")


def evaluated(df: DataFrame, patterns: DataFrame, percentile: float, by: list[str], least: float = 0.45) -> DataFrame:
    """Confusion of described() patterns with the posts of `df` from its score percentile on."""
    test = M.matched(df, patterns, least).crossJoin(F.broadcast(M.viral_threshold(df, percentile, [])))
    return M.confusion(test, F.col("predicted"), F.col("upvotes") >= F.col("threshold"), by)


def holdout(df: DataFrame, n: int = 5, percentile: float = 0.9, ratio: float = 0.7) -> DataFrame:
    """Patterns of the other communities on the held-out ones: precision of both, their ratio, and whether it is enough. Texts
    are scanned once, by prepared(), and the mined patterns are a small table that both sides read."""
    f = prepared(df).withColumn("_s", F.lower("subreddit"))
    out = F.broadcast(holdout_communities(df, n).select(F.col("subreddit").alias("_s")))
    train, test = f.join(out, "_s", "left_anti"), f.join(out, "_s", "left_semi")
    patterns = written(M.described(train, written(M.over_represented(train, percentile), "mined"), percentile), "patterns")
    a, b = (evaluated(x, patterns, percentile, []).select(F.col("precision").alias(f"{k}_precision"), F.col("recall").alias(f"{k}_recall")) for x, k in ((train, "train"), (test, "holdout")))
    r = F.col("holdout_precision") / F.greatest("train_precision", F.lit(0.001))
    return a.crossJoin(b).withColumn("ratio", r).withColumn("transfer", F.least("ratio", F.lit(1.0))).withColumn("passed", F.col("ratio") >= ratio)


def patterns_by_tier(df: DataFrame, percentile: float = 0.9, least: int = 10, least_viral: int = 5, critical: float = 3.841459, top: int = 8) -> DataFrame:
    """over_represented() within each tier, with the tier's own threshold and totals, in one job. `df` has features()."""
    keys = ["hook", "narrative", "content_type"]
    g = df.join(F.broadcast(M.viral_threshold(df, percentile, ["tier"])), "tier").groupBy("tier", *keys).agg(F.count_if(F.col("upvotes") >= F.col("threshold")).alias("viral"), F.count("*").alias("n"))
    whole = g.groupBy("tier").agg(F.sum("viral").alias("av"), F.sum("n").alias("an"))
    c = g.join(F.broadcast(whole), "tier").where((F.col("n") >= least) & (F.col("viral") >= least_viral))
    x = M.chi_square(F.col("viral"), F.col("n") - F.col("viral"), F.col("av") - F.col("viral"), F.col("an") - F.col("n") - F.col("av") + F.col("viral"))
    c = c.withColumn("chi2", x).where((F.col("chi2") >= critical) & (F.col("viral") * F.col("an") > F.col("av") * F.col("n")))
    c = c.withColumn("rate", F.col("viral").cast("double") / F.col("n").cast("double"))
    rank = F.row_number().over(W.partitionBy("tier").orderBy(F.desc(F.round(F.col("rate") * F.log("n"), 9)), *keys))
    return c.withColumn("rank", rank).where(F.col("rank") <= top).select("tier", *keys, "viral", "n", "rate", "chi2", "rank")


def universal(by_tier: DataFrame, tiers: int = 3) -> DataFrame:
    """Which patterns hold in all tiers, and which in one only."""
    g = by_tier.groupBy("hook", "narrative", "content_type").agg(F.count_distinct("tier").alias("tiers"), F.min("tier").alias("first_tier"))
    return g.withColumn("kind", F.when(F.col("tiers") >= tiers, "universal").when(F.col("tiers") == 1, "specific").otherwise("shared"))


TIERS = ("t1", "t2", "t3")


def by_tier_confusion(train: DataFrame, test: DataFrame, percentile: float, pairs: Column, least: float = 0.45, patterns: DataFrame | None = None) -> DataFrame:
    """Patterns mined in each tier of `train` against the posts of `test`: confusion by (source_tier, target_tier). `pairs` says
    from a post's tier and source_tier whether the two meet; a post is viral from its tier's percentile in `test` on. Both
    have features(). All tiers are mined and matched in one plan: the patterns, at most a top-k of each tier, travel as one array, and
    a post is asked once per source tier."""
    found = described_by_tier(train, percentile) if patterns is None else patterns
    fields = ["tier", "hook", "narrative", "template", "t_lo", "t_hi", "b_lo", "b_hi"]
    all_of = found.agg(F.collect_list(F.struct(*fields)).alias("_patterns"))
    lines = M.viral_threshold(test, percentile, ["tier"])
    posts = test.join(F.broadcast(lines), "tier").crossJoin(F.broadcast(all_of))
    asked = posts.withColumn("source_tier", F.explode(F.array(*[F.lit(t) for t in TIERS]))).where(pairs)
    predicted = F.exists("_patterns", lambda x: (x["tier"] == F.col("source_tier")) & (M.match_score(x) >= least))
    rows = asked.withColumn("target_tier", F.col("tier"))
    return M.confusion(rows, predicted, F.col("upvotes") >= F.col("threshold"), ["source_tier", "target_tier"])


def described_by_tier(train: DataFrame, percentile: float) -> DataFrame:
    """patterns_by_tier() with templates and ranges of their tier's viral posts."""
    return M.described(train, patterns_by_tier(train, percentile), percentile, ["tier"])


def prepared(df: DataFrame) -> DataFrame:
    """What mining and matching read of the posts, as a table in the shared folder: texts are scanned once."""
    body = F.when(F.col("body") != "", "+").otherwise("").alias("body")  # matching asks only whether there is one
    return written(M.features(df).select("post_id", *[x for x in ("doc_id",) if x in df.columns], "subreddit", "tier", "hook", "narrative", "content_type", "title", body, "title_words", "body_words", "upvotes", "created_utc"), "prepared")


def transfer_matrix(df: DataFrame, percentile: float = 0.8) -> DataFrame:
    """Patterns mined in one tier, evaluated on the posts of each other one."""
    f = prepared(df)
    return by_tier_confusion(f, f, percentile, F.col("source_tier") != F.col("tier"))


def stratified(df: DataFrame, split_at: str, n: int = 5, percentile: float = 0.8, recall: float = 0.4, precision: float = 0.3, ratio: float = 0.7, least_posts: int = 100) -> DataFrame:
    """The gate by tier, a row each: the backtest before and from `split_at` on, the precision of patterns of a tier's other
    communities on `n` held-out ones (by the hash of the name) and on their own, and whether either is enough; `passed` is true
    on all rows if some tier's backtest and some tier's holdout are. Tiers with fewer than `least_posts` posts have no row."""
    f = prepared(df)
    own = F.col("source_tier") == F.col("tier")
    at = F.lit(split_at).cast("timestamp")
    back = by_tier_confusion(f.where(F.col("created_utc") < at), f.where(F.col("created_utc") >= at), percentile, own)
    names = f.groupBy("tier", F.lower("subreddit").alias("_s")).agg(F.md5(F.concat_ws("-", F.first(F.lower("subreddit")), F.lit("42")).cast("binary")).alias("_h"))
    held = names.withColumn("_i", F.row_number().over(W.partitionBy("tier").orderBy("_h", "_s"))).where(F.col("_i") <= n).select("tier", "_s", F.lit(True).alias("_held"))
    marked = f.withColumn("_s", F.lower("subreddit")).join(held, ["tier", "_s"], "left")
    train, test = marked.where("_held IS NULL"), marked.where("_held")
    mined = written(described_by_tier(train, percentile), "patterns")
    a, b = (by_tier_confusion(train, x, percentile, own, patterns=mined).select("target_tier", F.col("precision").alias(k)) for x, k in ((train, "train_precision"), (test, "holdout_precision")))
    sizes = f.groupBy(F.col("tier").alias("target_tier")).agg(F.count("*").alias("n")).where(F.col("n") >= least_posts)
    out = sizes.join(back.drop("source_tier"), "target_tier", "left").join(a, "target_tier", "left").join(b, "target_tier", "left")
    held_ratio = F.col("holdout_precision") / F.greatest("train_precision", F.lit(0.001))
    out = out.withColumn("ratio", held_ratio).withColumns({"backtest_passed": F.coalesce((F.col("recall") >= recall) & (F.col("precision") >= precision), F.lit(False)), "holdout_passed": F.coalesce(F.col("ratio") >= ratio, F.lit(False))})
    gate = out.agg((F.max("backtest_passed") & F.max("holdout_passed")).alias("passed"))
    return out.crossJoin(F.broadcast(gate)).select(F.col("target_tier").alias("tier"), "n", "precision", "recall", "f1", "train_precision", "holdout_precision", "ratio", "backtest_passed", "holdout_passed", "passed")


def ml_features(df: DataFrame, encoding: DataFrame) -> DataFrame:
    """The numbers of NUMBERS and the label of each post. `encoding` (subreddit, threshold, n, viral_rate) comes from the
    training posts; a community that it lacks takes the whole's weighted rate and the median of the thresholds."""
    t, b = F.col("title"), F.col("body")
    whole = encoding.agg((F.sum(F.col("viral_rate") * F.col("n")) / F.sum("n")).alias("_rate"), F.median("threshold").alias("_threshold"))
    # a column of its own, as grade and ease both read it
    d = M.features(df).withColumn("_read", T.readability(b)).join(encoding.select("subreddit", "viral_rate", "threshold"), "subreddit", "left").crossJoin(F.broadcast(whole))
    hour, day = F.coalesce(F.hour("created_utc"), F.lit(12)), F.coalesce(F.weekday("created_utc"), F.lit(3))
    turn = lambda x, n: 2 * 3.141592653589793 * x / n
    index = lambda column, names: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in names]), F.col(column)) - 1, F.lit(-1))
    low = F.lower(t)
    exclamations = F.regexp_count(t, F.lit("!"))
    read = F.col("_read")
    values = {
        "title_chars": F.length(t), "body_chars": F.length(b), "ratio": F.col("body_words") / F.greatest("title_words", F.lit(1)), "grade": read["grade"], "ease": read["ease"],
        "hour_sin": F.sin(turn(hour, 24)), "hour_cos": F.cos(turn(hour, 24)), "day_sin": F.sin(turn(day, 7)), "day_cos": F.cos(turn(day, 7)), "weekend": day >= 5,
        **{f"is_{k}": F.col("content_type") == k for k in ("text", "image", "video", "link")}, **{f"is_{k}": F.col("tier") == k for k in ("t1", "t2", "t3")},
        "viral_rate": F.coalesce("viral_rate", "_rate"), "hook_index": index("hook", T.HOOKS), "narrative_index": index("narrative", _MODES),
        "question": F.contains(t, F.lit("?")), "number": t.rlike("[0-9]"), "exclamation": exclamations > 0, "caps": F.regexp_count(t, F.lit(r"\p{Lu}")) / F.greatest(F.length(t), F.lit(1)),
        "starts_how": F.startswith(low, F.lit("how ")), "starts_why": F.startswith(low, F.lit("why ")), "exclamations": exclamations,
        "url": T.has_any(F.lower(b), ("http://", "https://")), "code": F.contains(b, F.lit("```")), "paragraphs": T.paragraphs(b), "bold": F.contains(b, F.lit("**")), "list": b.rlike(r"(?m)^\s*[*\-\d+.]\s"),
    }
    label = F.col("upvotes") >= F.coalesce("threshold", "_threshold")
    numbers = {k: F.coalesce(values[k].cast("double") if k in values else F.col(k).cast("double"), F.lit(0.0)) for k in NUMBERS}
    return d.select("post_id", "created_utc", *[v.alias(k) for k, v in numbers.items()], label.alias("label"))


def valence_lexicon(df: DataFrame, least: int = 20) -> DataFrame:
    """(word, valence) of title words in `least` titles or more: how far their mean score lies from that of all, in tenths."""
    words = df.select("post_id", "upvotes", F.explode(T.letter_words(F.col("title"))).alias("word")).distinct()
    g = words.groupBy("word").agg(F.count("*").alias("n"), F.avg("upvotes").alias("m")).where(F.col("n") >= least)
    return g.crossJoin(F.broadcast(df.agg(F.avg("upvotes").alias("_all")))).select("word", F.round(F.col("m") / F.col("_all") - 1, 1).alias("valence"))


def valence_scores(df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(post_id, compound): the valences of a title's words, summed to s and scaled to s / sqrt(s * s + 15); 0 without a hit."""
    words = df.select("post_id", F.explode(T.letter_words(F.col("title"))).alias("word"))
    s = words.join(lexicon, "word").groupBy("post_id").agg(F.sum("valence").alias("_s"))
    return df.select("post_id").join(s, "post_id", "left").select("post_id", F.coalesce(F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + 15), F.lit(0.0)).alias("compound"))


def sweep(scored: DataFrame, grid: list[float], by: list[str] | None = None) -> DataFrame:
    """Confusion at each threshold of `grid` for rows (probability, label): rows are counted by probability first."""
    counts = scored.groupBy("probability").agg(F.count_if("label").alias("yes"), F.count_if(~F.col("label")).alias("no"))
    g = counts.select("*", F.explode(F.array(*[F.lit(x) for x in grid])).alias("cutoff")).groupBy("cutoff")
    above = F.col("probability") >= F.col("cutoff")
    g = g.agg(*[F.sum(F.when(test, F.col(c)).otherwise(0)).alias(k) for k, test, c in (("tp", above, "yes"), ("fp", above, "no"), ("fn", ~above, "yes"))])
    share = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(a) + F.col(b), F.lit(1)).cast("double")
    g = g.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})
    return g.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(0.001)))


def calibrated(swept: DataFrame, least_precision: float = 0.3, least_recall: float = 0.6) -> DataFrame:
    """The threshold to take: the best f1 that meets both floors, else the best recall that meets the floor of precision, else
    the best f1; ties go to the smaller threshold."""
    p, r = F.col("precision") >= least_precision, F.col("recall") >= least_recall
    pass_ = F.when(p & r & (F.col("f1") > 0), 1).when(p & (F.col("recall") > 0), 2).otherwise(3)
    key = F.when(pass_ == 2, F.col("recall")).otherwise(F.col("f1"))
    return swept.withColumns({"pass": pass_, "_k": key}).orderBy("pass", F.desc("_k"), "cutoff").limit(1).drop("_k")


def fitted(df: DataFrame, split_at: str, percentile: float = 0.75, trees: int = 10, depth: int = 4, least_rows: int = 100, least_class: int = 20):
    """A gradient-boosted model of the posts before `split_at` and the later posts as vectors. Too few rows of a side or class:
    no model."""
    dated = df.where("created_utc IS NOT NULL")
    at = F.lit(split_at).cast("timestamp")
    encoding = M.target_encoding(dated.where(F.col("created_utc") < at), percentile)
    rows = VectorAssembler(inputCols=list(NUMBERS), outputCol="features").transform(ml_features(dated, encoding)).select(F.col("created_utc"), "features", F.col("label").cast("double").alias("label")).cache()
    train, test = rows.where(F.col("created_utc") < at), rows.where(F.col("created_utc") >= at)
    n = train.agg(F.count("*").alias("n"), F.sum("label").alias("k")).crossJoin(test.agg(F.count("*").alias("m"))).first()
    if n["n"] < least_rows or n["m"] < least_rows or not least_class <= (n["k"] or 0) <= n["n"] - least_class:
        return None, test
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, subsamplingRate=1.0).fit(train), test


def boosted(df: DataFrame, split_at: str, **settings) -> DataFrame:
    """(probability, label) of the later posts by fitted(); no model, no rows."""
    model, test = fitted(df, split_at, **settings)
    if model is None:
        return df.sparkSession.createDataFrame([], "probability double, label boolean")
    return model.transform(test).select(vector_to_array("probability")[1].alias("probability"), (F.col("label") == 1).alias("label"))


def importances(df: DataFrame, split_at: str, top: int = 15, least: float = 0.01, **settings) -> DataFrame:
    """The model's most important features over `least`, and whether each is at the median of all or above, which is the test
    for keeping it. One row for each of at most `top` features."""
    model, _ = fitted(df, split_at, **settings)
    value = [float(x) for x in model.featureImportances.toArray()] if model else []
    middle = sorted(value)[len(value) // 2] if value else 0.0
    rows = sorted(((x, k, x >= middle) for k, x in zip(NUMBERS, value) if x > least), key=lambda r: (-r[0], r[1]))[:top]
    return df.sparkSession.createDataFrame(rows, "importance double, feature string, selected boolean")
