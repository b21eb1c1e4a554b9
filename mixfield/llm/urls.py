"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule covers."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixfield.llm.common import smallest, written

#: ``(verdict, host, beginning of the path)``.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: At most so many labelled URLs, those with the smallest hash, train the trees.
FIT_URLS = 4000
LEXICAL = ("length", "host_length", "labels", "depth", "digits", "entropy", "parameters", "longest_label", "hyphens", "ending_length", "secure", "last_label", "first_part")
#: Statistics of the host's suffix: how many pages have it, and the share of blocked ones among the labelled URLs.
FEATURES = (*LEXICAL, "suffix_pages", "suffix_rate")
#: Labelled URLs are dealt into so many folds; the share that a URL is trained with comes from the other folds.
FOLDS = 4


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``rule, verdict`` of the rule that fits and is longest, host and path together; null if none fits."""
    fits = [
        F.when(((host == name) | host.endswith("." + name)) & path.startswith(start), F.struct(F.lit(len(name) + len(start)).alias("n"), F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, name, start in rules
    ]
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def entropy(text: Column) -> Column:
    """Bits of entropy a character, from the 128 ASCII characters and all others together."""
    n = F.length(text).cast("double")
    letters = F.split(text, "")
    runs = F.aggregate(
        F.array_sort(letters),
        F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).cast("double").alias("sum")),
        lambda s, c: F.when(s["last"] == c, F.struct(c.alias("last"), (s["run"] + 1).alias("run"), s["sum"].alias("sum"))).otherwise(
            F.struct(c.alias("last"), F.lit(1).alias("run"), (s["sum"] + F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(F.lit(0.0))).alias("sum"))
        ),
        lambda s: s["sum"] + F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(F.lit(0.0)),
    )
    return F.when(n > 0, F.log2(n) - runs / n).otherwise(0.0)


def place_of(text: Column) -> Column:
    """The place of a text in alphabetical order, by its first two letters."""
    letters = [F.lower(F.substring(text, k, 1)) for k in (1, 2)]
    first, second = (F.when(x != "", F.call_function("locate", x, F.lit("abcdefghijklmnopqrstuvwxyz"))).otherwise(0) for x in letters)
    return (27 * first + second).cast("double")


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``suffix`` (the host's last two labels) and the lexical features of ``url``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    labels = F.split("host", r"\.")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda pattern: F.length(F.regexp_replace(url, pattern, "")).cast("double")
    return rows.select(
        "*",
        F.substring_index("host", ".", -2).alias("suffix"),
        F.length(url).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.size(labels).cast("double").alias("labels"),
        F.length(F.regexp_replace("path", "[^/]", "")).cast("double").alias("depth"),
        F.when(F.length(url) > 0, count("[^0-9]") / F.length(url)).otherwise(0.0).alias("digits"),
        entropy(url).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.length(F.regexp_replace(query, "[^&]", "")) + 1.0).alias("parameters"),
        F.array_max(F.transform(labels, F.length)).cast("double").alias("longest_label"),
        count("[^-]").alias("hyphens"),
        F.length(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).cast("double").alias("ending_length"),
        F.when(url.startswith("https://"), 1.0).otherwise(0.0).alias("secure"),
        place_of(F.substring_index("host", ".", -1)).alias("last_label"),
        place_of(F.regexp_extract("path", "^/([^/]*)", 1)).alias("first_part"),
    )


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), url), F.lit(FOLDS))


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """``suffix, pages, blocked, labelled`` over all of ``rows(url, suffix, blocked)``, the last two as an array by fold."""
    by_fold = lambda what: F.array(*(F.sum(F.when(fold_of(F.col("url")) == k, what).otherwise(0)) for k in range(FOLDS)))
    known = F.col("blocked").isNotNull().cast("long")
    return rows.groupBy("suffix").agg(F.count("*").alias("pages"), by_fold(F.coalesce("blocked", F.lit(0)).cast("long")).alias("in_fold_blocked"), by_fold(known).alias("in_fold_labelled"))


def with_statistics(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``suffix_pages`` and ``suffix_rate``, drawn towards one half by one URL of each label.

    A labelled URL's share leaves out its own fold, so no label is among a URL's own features.
    """
    every = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x)
    fold = fold_of(F.col("url"))
    own = lambda name: F.when(F.col("blocked").isNotNull(), F.get(name, fold.cast("int"))).otherwise(0)
    rate = (every("in_fold_blocked") - own("in_fold_blocked") + 1.0) / (every("in_fold_labelled") - own("in_fold_labelled") + 2.0)
    rows = rows.join(known, "suffix", "left").withColumn("suffix_pages", F.coalesce(F.ln(F.col("pages") + 1.0), F.lit(0.0)))
    return rows.withColumn("suffix_rate", F.coalesce(rate, F.lit(0.5))).drop("pages", "in_fold_blocked", "in_fold_labelled")


def with_vector(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(rows)


def sampled(labelled: DataFrame, urls: int = FIT_URLS) -> DataFrame:
    """At most ``urls`` rows with a label, those with the smallest hash of URL and page_id."""
    return smallest(labelled.where("blocked is not null"), urls, *(c for c in ("url", "page_id") if c in labelled.columns))


def train(rows: DataFrame) -> GBTClassificationModel | None:
    """Trees for a sample ``rows(blocked, ...)`` with all features; none if only one label occurs."""
    rows = with_vector(rows.select("blocked", *FEATURES).coalesce(1)).select("features", F.col("blocked").cast("double").alias("label")).cache()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        return GBTClassifier(maxIter=20, maxDepth=4, maxBins=64, stepSize=0.3, seed=7).fit(rows)
    finally:
        rows.unpersist()


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for each row of ``pages(page_id, url)``.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case, the path what follows up to ``?``, ``#`` or the
    end; both are empty for null and without ``://``. A rule fits its host and all subdomains if the path begins as the rule's; the longest decides. URLs
    that a rule decides are the labelled ones: they train boosted trees on lexical features and statistics of the suffix, which decide the others. ``score`` is the
    trees' probability of blocking. If the rules leave fewer than two labels, the trees decide nothing and such URLs are allowed. A page_id
    may be null or repeated; other columns are dropped.
    """
    rows = lexical(pages.select("page_id", F.col("url").cast("string")))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("blocked", F.when(F.col("_rule").isNotNull(), (F.col("_rule.verdict") == "block").cast("int")))
    # a table of its own: Spark sees whether it is small, and sends it to the URLs instead of shuffling those by suffix
    known = written(suffix_statistics(rows.select("url", "suffix", "blocked")), "suffixes")
    model = train(with_statistics(sampled(rows), known))
    rows = with_statistics(rows, known)
    if model is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(with_vector(rows)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")
