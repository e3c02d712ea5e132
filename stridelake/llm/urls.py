"""URL verdicts by rules, and by boosted trees on lexical features where no rule fits.

URLs that a rule decides are the labelled ones: gradient-boosted trees learn from them and judge the rest.  Features are
lengths, depth, digit ratio, entropy, parameter counts and statistics of the host's suffix among labelled URLs (its own
label left out in training).

A null URL, or one without ``://``, has an empty host and path; no rule fits it and the trees judge it.  Where the
labels are of one class only, that class is the verdict; without labels it is ``allow``.  Repeated rows are judged alike.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame

from stridelake.llm.samples import bounded

#: (verdict, host and path) as given.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Labelled URLs that train (about, at most).
TRAINING_ROWS = 30_000
#: Labelled URLs that a suffix without any counts as, at the overall rate.
SUFFIX_PRIOR = 5.0
FEATURES = (
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_host_entropy", "f_parameters", "f_query_length",
    "f_hyphens", "f_percents", "f_secure", "f_longest", "f_suffix_rate", "f_suffix_seen",
)
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, pattern, 1), _CAPITALS, _SMALL), F.regexp_extract(whole, pattern, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct of rule and verdict, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character of the distribution of characters."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    characters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(size > 0, F.aggregate(characters, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))).otherwise(0.0)


def _lexical(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = split_url(F.col("url"))
    named = pages.withColumn("__url", url).withColumn("__host", host).withColumn("__path", path)
    url, host, path = F.col("__url"), F.col("__host"), F.col("__path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    columns = {
        "f_length": F.length(url), "f_host_length": F.length(host), "f_path_length": F.length(path), "f_depth": count(path, "/[^/]"),
        "f_labels": count(host, r"\."), "f_digits": F.when(F.length(url) > 0, count(url, "[0-9]") / F.length(url)).otherwise(0.0),
        "f_entropy": entropy(url), "f_host_entropy": entropy(host), "f_parameters": count(query, "[^&]+"), "f_query_length": F.length(query),
        "f_hyphens": count(url, "-"), "f_percents": count(url, "%"), "f_secure": F.startswith(url, F.lit("https:")).cast("int"),
        "f_longest": F.coalesce(F.array_max(F.transform(F.split(path, "[/._-]"), F.length)), F.lit(0)),
    }
    return named.withColumns({k: v.cast("double") for k, v in columns.items()}).withColumn("__suffix", F.regexp_extract(host, r"([^.]*)$", 1))


def _with_suffix(df: DataFrame, statistics: DataFrame, rate: float, own: bool) -> DataFrame:
    """Smoothed share of blocked URLs of the suffix, without the row's own label."""
    joined = df.join(statistics, "__suffix", "left")
    label = F.col("__label") if own else F.lit(0.0)
    blocked, seen = F.coalesce("__blocked", F.lit(0.0)) - label, F.coalesce("__seen", F.lit(0.0)) - F.lit(float(own))
    smooth = (blocked + SUFFIX_PRIOR * rate) / (seen + SUFFIX_PRIOR)
    return joined.withColumn("f_suffix_rate", smooth).withColumn("f_suffix_seen", F.log1p(F.greatest(seen, F.lit(0.0)))).drop("__blocked", "__seen")


def url_verdicts(pages: DataFrame, rules=RULES, rows: int = TRAINING_ROWS) -> DataFrame:
    """Per row of ``page_id, url``: page_id, host, path, rule, verdict, and the trees' score for ``block`` (null under a rule)."""
    ruled = _lexical(pages.select("page_id", "url")).withColumn("__rule", longest_rule(F.col("__host"), F.col("__path"), rules))
    labelled = ruled.where("__rule is not null").withColumn("__label", F.when(F.col("__rule.verdict") == "block", 1.0).otherwise(0.0))
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("__label"), F.lit(0.0))).first()
    if not 0 < blocked < n:
        constant = "block" if n and blocked == n else "allow"
        judged = ruled.withColumn("verdict", F.coalesce("__rule.verdict", F.lit(constant))).withColumn("score", F.lit(None).cast("double"))
    else:
        rate = blocked / n
        statistics = labelled.groupBy("__suffix").agg(F.sum("__label").alias("__blocked"), F.count("*").cast("double").alias("__seen"))
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="__features")
        train = assembler.transform(_with_suffix(bounded(labelled, "page_id", rows), statistics, rate, True)).select("__features", "__label")
        trees = GBTClassifier(featuresCol="__features", labelCol="__label", maxDepth=4, maxIter=15, stepSize=0.2, seed=11).fit(train)
        trees.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("__probability")
        scored = trees.transform(assembler.transform(_with_suffix(ruled, statistics, rate, False)))
        score = vector_to_array("__probability")[1]
        judged = scored.withColumn("verdict", F.coalesce("__rule.verdict", F.when(score >= 0.5, "block").otherwise("allow"))).withColumn(
            "score", F.when(F.col("__rule").isNull(), score))
    return judged.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"), "verdict", "score")
