"""Per-model reports and run summaries.

All are grouped aggregates with partial (map-side) aggregation; the grouping key is
the model, so the shuffle carries one partial row per model per task.
Two BM25 averages exist on purpose: the stored-score report (A1) clamps and keeps
zeros; the run summary (A4) drops zeros and NULLs and does not clamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from evidence_spark.functions.metrics import clamp0_report, round_half_up

METRICS = ["recall", "precision", "f1", "bm25", "format_score"]
OUTCOMES = ["scored", "judge_error", "crash", "skipped"]


def model_report(scores: DataFrame, model: str | None = None) -> DataFrame:
    """A1/A2 (+L1 order): means of the five stored metrics per model.

    NULL, NaN and negative values count as 0; no upper clamp; rounded to 4 places.
    With ``model`` only that model (the filter is pushed below the aggregate); an
    empty result means "no results".
    """
    src = scores.where(F.col("model") == model) if model else scores
    aggs = [round_half_up(F.avg(clamp0_report(m)), 4).alias(f"avg_{m}") for m in METRICS]
    return src.groupBy("model").agg(*aggs, F.count(F.lit(1)).alias("count")).orderBy("model")


def run_summary(results: DataFrame, key: str | None = None) -> DataFrame:
    """A3: mean recall/precision/F1 over rows with a non-NULL F1, not clamped.

    One row per model; 0 means and count 0 when a model has no such row. ``key`` names
    a struct column holding the metrics (the nested form).
    """
    def m(name):
        return F.col(f"{key}.{name}") if key else F.col(name)

    has = m("f1").isNotNull()
    out = results.groupBy("model").agg(
        *[
            F.coalesce(round_half_up(F.avg(F.when(has, m(x))), 4), F.lit(0.0)).alias(f"avg_{x}")
            for x in ("recall", "precision", "f1")
        ],
        F.count(F.when(has, F.lit(1))).alias("count"),
    )
    return out


def bm25_summary(results: DataFrame, fallback: str | None = None) -> DataFrame:
    """A4: mean BM25 over non-zero, non-NULL values (a zero is read as missing and the
    optional ``fallback`` column is used instead; a zero there is kept)."""
    v = F.when(F.col("bm25") != 0, F.col("bm25"))
    if fallback:
        v = F.coalesce(v, F.col(fallback))
    return results.groupBy("model").agg(
        F.coalesce(round_half_up(F.avg(v), 4), F.lit(0.0)).alias("avg_bm25"),
        F.count(v).alias("count"),
    )


def format_summary(results: DataFrame) -> DataFrame:
    """A5: mean format score per model; zeros kept, NULLs (crashed rows) dropped."""
    return results.groupBy("model").agg(
        F.coalesce(round_half_up(F.avg("format_score"), 4), F.lit(0.0)).alias("avg_format_score"),
        F.count("format_score").alias("count"),
    )


def evaluation_summary(results: DataFrame) -> DataFrame:
    """A3 + A4 + A5 and the A11 counts of one run in one aggregate, one row per model."""
    has = F.col("f1").isNotNull()
    v = F.when(F.col("bm25") != 0, F.col("bm25"))

    def mean(c):
        return F.coalesce(round_half_up(F.avg(c), 4), F.lit(0.0))

    return results.groupBy("model").agg(
        *[mean(F.when(has, F.col(x))).alias(f"avg_{x}") for x in ("recall", "precision", "f1")],
        F.count("f1").alias("n_f1"),
        mean(v).alias("avg_bm25"),
        F.count(v).alias("n_bm25"),
        mean("format_score").alias("avg_format_score"),
        F.count("format_score").alias("n_format"),
        *[F.count(F.when(F.col("status") == s, F.lit(1))).alias(f"n_{s}") for s in OUTCOMES],
    )


def counted_while_written(results: DataFrame) -> tuple[DataFrame, Observation]:
    """A11 without a second scan: the rows, and the number of each outcome.

    The numbers (``scored``, ``judge_error``, ...) are in ``Observation.get`` once the rows
    have been written; they are summed as the tasks pass rows on.
    """
    seen = Observation()
    counts = [F.count(F.when(F.col("status") == o, F.lit(1))).alias(o) for o in OUTCOMES]
    return results.observe(seen, *counts), seen


def outcome_counts(results: DataFrame) -> DataFrame:
    """Rows per (model, status)."""
    return results.groupBy("model", "status").agg(F.count(F.lit(1)).alias("n"))


def candidate_count(candidates: DataFrame) -> DataFrame:
    """Number of candidate documents, as a one-row DataFrame."""
    return candidates.agg(F.count(F.lit(1)).alias("count"))


def split_counts(corpus: DataFrame, split_col: str = "split") -> DataFrame:
    """A10: rows per split plus the total (``is_total`` = 1)."""
    return corpus.rollup(split_col).agg(
        F.count(F.lit(1)).alias("n"), F.grouping(split_col).cast("bigint").alias("is_total")
    )


def compare_settings(
    df: DataFrame, by: list[str], setting: str, value: str, before: str, after: str, digits: int = 4
) -> DataFrame:
    """Mean of ``value`` per group in two settings, and the difference after-before."""
    piv = df.groupBy(*by).pivot(setting, [before, after]).agg(F.avg(value))
    b, a = F.col(f"`{before}`"), F.col(f"`{after}`")
    return piv.select(
        *by,
        round_half_up(b, digits).alias("before"),
        round_half_up(a, digits).alias("after"),
        round_half_up(a - b, digits).alias("improvement"),
    )


def metrics_long(results: DataFrame, metrics=("recall", "precision", "f1")) -> DataFrame:
    """Unpivot metric columns to (uuid, model, metric, value) for :func:`compare_settings`."""
    return results.unpivot(["uuid", "model"], list(metrics), "metric", "value")
