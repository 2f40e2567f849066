"""Test set and score tables (S9, S11, S13) as keyed long tables.

Scores are stored long: ``(uuid, model, recall, precision, f1, bm25, format_score)``.
The nested form ``(uuid, scores map<model, struct>)`` exists only at the edge
(import/export) and is converted with ``explode`` / ``map_from_entries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.operators.keyed import last_wins, upsert

SCORE_COLUMNS = ["recall", "precision", "f1", "bm25", "format_score"]
TESTSET_COLUMNS = ["uuid", "question", "answer", "context", "quotes"]


def scores_from_nested(nested: DataFrame) -> DataFrame:
    """Documents that have scores, only that field, as long rows."""
    e = nested.where(F.col("scores").isNotNull()).select("uuid", F.explode("scores").alias("model", "s"))
    return e.select("uuid", "model", *[F.col(f"s.{c}").cast("double").alias(c) for c in SCORE_COLUMNS])


def scores_to_nested(scores: DataFrame) -> DataFrame:
    """Edge export: one row per uuid with ``scores`` map<model, struct>.

    The map of one uuid holds one entry per model, bounded by the number of models.
    """
    entry = F.struct(F.col("model"), F.struct(*SCORE_COLUMNS))
    return scores.groupBy("uuid").agg(F.map_from_entries(F.collect_list(entry)).alias("scores"))


def write_scores(current: DataFrame | None, new_scores: DataFrame) -> DataFrame:
    """Keyed upsert of score rows by (uuid, model); returns the new table."""
    new = new_scores.select("uuid", "model", *SCORE_COLUMNS)
    if current is None:
        return new
    return upsert(current.select("uuid", "model", *SCORE_COLUMNS), new, ["uuid", "model"])


def upsert_testset(
    current: DataFrame | None,
    records: DataFrame,
    inferences: DataFrame | None = None,
    scores: DataFrame | None = None,
    *,
    order: list[str],
    unique_order: bool = False,
) -> tuple[DataFrame, DataFrame | None, DataFrame | None, DataFrame]:
    """Whole-record upsert of test records by uuid: of repeated uuids the last in ``order``
    (``unique_order``: no two records of a uuid have the same place in it).

    A replaced record loses its inferences and scores, as a whole-record replace does.
    Returns (test set, inferences, scores, written-count). The count is the number of
    records written, so a repeated uuid counts each time, as in the original.
    """
    recs = records.select(*TESTSET_COLUMNS, *order)
    count = recs.agg(F.count(F.lit(1)).alias("upserted"))
    latest = last_wins(recs, ["uuid"], order, unique=unique_order).select(*TESTSET_COLUMNS)
    table = latest if current is None else upsert(current.select(*TESTSET_COLUMNS), latest, ["uuid"])
    replaced = latest.select("uuid")
    inf = None if inferences is None else inferences.join(replaced, "uuid", "left_anti")
    sc = None if scores is None else scores.join(replaced, "uuid", "left_anti")
    return table, inf, sc, count
