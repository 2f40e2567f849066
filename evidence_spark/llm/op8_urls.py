"""URL filter: host/path rules first, logistic regression on hashed character n-grams for the rest.

A url is split into host and path; the longest rule that fits decides. The urls that rules
decide are also the labelled table: a bounded, hash-chosen part of them (``train_rows``)
trains a logistic regression on hashed character n-grams, and the model decides every url
without a rule. Feature extraction, training and scoring run as Spark ML stages.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, rule), a rule being its host, then its path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
GRAMS = (2, 3, 4)
TRAIN_ROWS = 20_000
N_FEATURES = 1 << 14
DEFAULT = "allow"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent domain and
    whose path the url's path starts with; nulls when none fits. Equal lengths: the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def char_grams(host: Column, path: Column, sizes=GRAMS) -> Column:
    """Character n-grams of ``^host$`` and ``^path$``, each marked with the part it comes from."""
    def of(part: Column, mark: str) -> Column:
        text = F.concat(F.lit("^"), part, F.lit("$"))

        def grams(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
            return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

        return F.flatten(F.array(*map(grams, sizes)))
    return F.concat(of(host, "h:"), of(path, "p:"))


def featurise(df: DataFrame, n_features: int = N_FEATURES) -> DataFrame:
    grams = df.withColumn("__grams", char_grams(F.col("host"), F.col("path")))
    return HashingTF(inputCol="__grams", outputCol="__x", numFeatures=n_features, binary=True).transform(grams).drop("__grams")


def train_url_model(labelled: DataFrame, *, train_rows: int = TRAIN_ROWS, n_features: int = N_FEATURES):
    """Fit on (host, path, verdict) rows; None when one of the two verdicts has no row.

    About ``train_rows`` distinct urls at most are used, chosen by a hash of the url's host
    and path over the whole table, so the choice does not depend on order or partitions.
    """
    rows = labelled.select("host", "path", (F.col("verdict") == "block").cast("double").alias("label")).distinct()
    seen = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return None
    share = min(1.0, train_rows / sum(seen.values()))
    if share < 1.0:
        bucket = F.pmod(F.xxhash64("host", "path"), F.lit(1 << 30))
        rows = rows.where(bucket < F.lit(int(share * (1 << 30))))
    fit = featurise(rows, n_features).coalesce(4).persist()
    try:
        return LogisticRegression(featuresCol="__x", labelCol="label", maxIter=25, regParam=1e-3,
                                  standardization=False).fit(fit)
    finally:
        fit.unpersist()


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES,
                train_rows: int = TRAIN_ROWS, n_features: int = N_FEATURES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, p_block (the model's probability).

    Null urls and urls without ``://`` have empty host and path, fit no rule and are judged by
    the model like any other. Where the rules leave no url of one verdict to learn from, the
    verdict of the rest is ``allow`` with a null probability. Other columns are not carried.
    """
    base = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("__u"))
    base = base.select(id_col, url_host(F.col("__u")).alias("host"), url_path(F.col("__u")).alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    judged = base.withColumn("rule", rule).withColumn("verdict", verdict)
    model = train_url_model(judged.where(F.col("rule").isNotNull()), train_rows=train_rows, n_features=n_features)
    if model is None:
        scored = judged.withColumn("p_block", F.lit(None).cast("double"))
    else:
        scored = model.transform(featurise(judged, n_features)).withColumn(
            "p_block", vector_to_array(F.col("probability"))[1])
    said = F.when(F.col("p_block") >= 0.5, F.lit("block")).otherwise(F.lit(DEFAULT))
    return scored.select(id_col, "host", "path", "rule", F.coalesce("verdict", said).alias("verdict"), "p_block")
