"""URL filtering on DataFrame functions only: host rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (action, host, path): fixed by the query's contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Words of unwanted hosts by kind (gambling, medicine, adult, money, counterfeits, advertising, link spam, stolen software)
#: and of ordinary ones. Hosts are made of two of them by a rule, so no host is listed.
_BAD = ("casino poker slots jackpot betting bets roulette bingo lottery win", "pills viagra pharmacy meds slim diet cheap", "adult xxx porn sex cams escorts singles hot", "loans payday credit forex cash rich bonus", "replica watches outlet discount bags", "ads adserver banner track tracker clicks popup affiliate", "spam backlinks links traffic seo farm", "crack keygen warez serial free download prizes")
_GOOD = "garden library weather cooking history science math travel news museum chess music nation station motion fiction theory thesis family anthem thistle north earth health theatre edition reaction thorn heron house sentinel school city river mountain bakery orchard village harbour church council college journal review letters nature birds forest bridge market farm track winter window freedom linked cashmere"
_SYLLABLES = "ber lin ton ham ford ville stead mar wick dale shire land burg mont port ing the tion er an re th ly ble sh on"
_SHAPES = ("http://{0}.example.org/en/{1}", "https://www.{0}.example.net/de/{1}.html", "http://blog.{0}.example.com/fr/{1}?page=2", "https://m.{0}.example.org/es/{1}/", "https://{0}.example.net/fr/{1}#top")


def labelled_hosts() -> list[tuple[str, float]]:
    """(first part of a host, 1 unwanted or 0): pairs of words of one kind and of words of neighbouring kinds, with and
    without a hyphen; ordinary words, pairs of them, and names of two or three syllables."""
    kinds = [k.split() for k in _BAD]
    bad = []
    for own, other in zip(kinds, kinds[1:] + kinds[:1]):
        for i, word in enumerate(own):
            bad += [word, f"{word}-{own[(i + 1) % len(own)]}", f"{own[(i + 2) % len(own)]}{word}", f"{word}-{other[i % len(other)]}", f"{other[(i + 1) % len(other)]}-{word}"]
    words, parts = _GOOD.split(), _SYLLABLES.split()
    good = [x for i, w in enumerate(words) for x in (w, f"{w}-{words[(i + 7) % len(words)]}", f"{words[(i + 3) % len(words)]}{w}")]
    good += [a + b for i, a in enumerate(parts) for b in parts[i % 3 :: 3]] + [a + parts[(i + 5) % len(parts)] + parts[(i + 9) % len(parts)] for i, a in enumerate(parts)]
    return [(x, 1.0) for x in bad] + [(x, 0.0) for x in good]


def labelled_urls(spark: SparkSession, hosts: list[tuple[str, float]] | None = None) -> DataFrame:
    """The default training table, (url, label): every host in one of the shapes. Pass a table of your own to url_filter()."""
    hosts = labelled_hosts() if hosts is None else hosts
    rows = [(_SHAPES[(i * i + i // 5) % len(_SHAPES)].format(host, 1000 + 7919 * i % 9000), label) for i, (host, label) in enumerate(hosts)]
    return spark.createDataFrame(rows, "url string, label double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no ://."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("1")), F.lit(0))
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    after = F.when(rest == 1, after).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column, sizes: tuple[int, ...], buckets: int) -> Column:
    """Hashes of the character n-grams of host and path; an n-gram of the host differs from the same one of the path. They are
    looked up in one walk over the text: a match of no width before each character, but not within a surrogate pair."""
    def of(kind: str, text: Column, n: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{{n}}}))"), F.lit(1))
        return F.transform(found, lambda g: F.pmod(F.xxhash64(F.lit(kind), g), F.lit(buckets)).cast("int"))

    parts = [of(kind, F.concat(F.lit("^"), part, F.lit("$")), n) for kind, part in (("h", host), ("p", path)) for n in sizes]
    return F.concat(*parts)


def fit(labelled: DataFrame, sizes: tuple[int, ...], buckets: int, max_rows: int, reg: float) -> tuple[list[float], float]:
    """Weights by bucket and intercept, fitted in the JVM on at most `max_rows` labelled URLs (those with the smallest hash)."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("url"), "url").limit(max_rows)
    rows = rows.select(F.col("label").cast("double").alias("label"), host.alias("_h"), path.alias("_p"))
    rows = rows.select("label", grams(F.col("_h"), F.col("_p"), sizes, buckets).cast("array<string>").alias("_g")).coalesce(1).cache()  # bounded by max_rows: one task a pass
    counter = CountVectorizer(inputCol="_g", outputCol="features", vocabSize=buckets).fit(rows)
    model = LogisticRegression(maxIter=60, regParam=reg, standardization=False).fit(counter.transform(rows))
    rows.unpersist()
    weights = [0.0] * buckets
    for bucket, x in zip(counter.vocabulary, model.coefficients.toArray()):
        weights[int(bucket)] = float(x)
    return weights, float(model.intercept)


def url_filter(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    sizes: tuple[int, ...] = (3, 4, 5),
    buckets: int = 8192,
    threshold: float = 0.5,
    max_rows: int = 10_000,
    reg: float = 0.003,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest fitting rule decides,
    else the model: block from `threshold` on. Null or malformed url: host and path are empty, no rule fits and the model
    judges the empty parts. Two rules of one length: the later one in `rules`. Rows repeat as in the input, an empty table
    gives no rows; only page_id and url are read. A very long url is an array of its n-grams. One pass without a shuffle: rules
    and weights (`buckets` numbers) are literals."""
    weights, intercept = fit(labelled if labelled is not None else labelled_urls(pages.sparkSession), sizes, buckets, max_rows, reg)
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule = F.lit(None).cast("string")
    action = F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == rule_host) | F.endswith("host", F.lit(f".{rule_host}"))) & F.startswith("path", F.lit(rule_path))
        rule, action = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, act).otherwise(action)
    table = F.lit(weights) if weights else F.array()
    df = df.withColumn("_g", grams(F.col("host"), F.col("path"), sizes, buckets))
    margin = F.aggregate("_g", F.lit(0.0), lambda a, g: a + F.get(table, g))  + intercept
    df = df.select("page_id", "host", "path", rule.alias("rule"), action.alias("_action"), (1 / (1 + F.exp(-margin))).alias("block_score"))
    verdict = F.coalesce("_action", F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return df.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op7_url_filters": op7_url_filters}
ORACLES: dict[str, str] = {}
