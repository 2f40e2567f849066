"""Evaluation of (document, model) pairs: candidates, samples, scores (S12, A6, J5,
P14, J3, T11, T12, J4).

One plan scores every model at once (model is a column, not a loop). Every join is
keyed by ``uuid``; the wide texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.functions.metrics import f1, repair_precision, round_half_up
from evidence_spark.functions.text import format_score, nz, parse_quotes
from evidence_spark.operators import bm25 as bm
from evidence_spark.operators.judge import judge_from_table, lexical_judge

SCORE_COLUMNS = ["recall", "precision", "f1", "bm25", "format_score"]
STATUS_SCORED = "scored"
STATUS_JUDGE_ERROR = "judge_error"
STATUS_CRASH = "crash"
STATUS_SKIPPED = "skipped"


def candidate_documents(testset: DataFrame, inferences: DataFrame, uuid: str | None = None) -> DataFrame:
    """Documents whose gold is not '' (NULL passes, as in the store filter) and
    that have at least one inference; optionally one uuid (pushed to the scan)."""
    ts = testset.where(F.col("quotes").isNull() | (F.col("quotes") != ""))
    if uuid:
        ts = ts.where(F.col("uuid") == uuid)
    return ts.join(inferences.select("uuid"), "uuid", "left_semi")


def available_models(candidates: DataFrame, inferences: DataFrame) -> DataFrame:
    """Distinct model names over the candidate documents."""
    return inferences.join(candidates.select("uuid"), "uuid", "left_semi").select("model").distinct()


def select_models(spark: SparkSession, available: DataFrame, models: list[str] | None) -> DataFrame:
    """Requested models that exist, in requested order (repeats kept) as (ord, model).

    With no request: every available model (ord NULL; report order is by name).
    The request list is a caller parameter, so broadcasting it has a known bound.
    """
    if not models:
        return available.select(F.lit(None).cast("bigint").alias("ord"), "model")
    req = spark.createDataFrame([(i, m) for i, m in enumerate(models)], "ord bigint, model string")
    return req.join(available, "model", "left_semi").select("ord", "model")


def gold_side(candidates: DataFrame) -> DataFrame:
    """Per-document gold text and quotes, one row per uuid."""
    g = candidates.select("uuid", F.col("quotes").alias("ground_truth"))
    return g.withColumn("gold_quotes", parse_quotes("ground_truth"))


def _by_uuid(rows: DataFrame, name: str, *cols: str) -> DataFrame:
    """(uuid, name): the rows of each uuid as a sorted array of (model, cols...).

    One entry per (uuid, model): bounded by the number of models. Of repeated entries the
    greatest is kept (deterministic; tables are meant to be unique on the pair).
    """
    entry = rows.select("uuid", "model", *cols).groupBy("uuid", "model").agg(F.max(F.struct(F.lit(1).alias("one"), *cols)).alias("e"))
    return entry.groupBy("uuid").agg(F.sort_array(F.collect_list(F.struct("model", *[F.col(f"e.{c}").alias(c) for c in cols]))).alias(name))


def _entry(name: str) -> Column:
    """The entry of the row's model in an array made by ``_by_uuid`` (NULL when absent)."""
    return F.get(F.filter(F.col(name), lambda e: e["model"] == F.col("model")), F.lit(0))


def evaluation_samples(
    testset: DataFrame,
    inferences: DataFrame,
    prior_scores: DataFrame | None = None,
    models: DataFrame | None = None,
    uuid: str | None = None,
    force: bool = False,
    judgments: DataFrame | None = None,
    keep_skipped: bool = False,
    parsed: bool = False,
) -> DataFrame:
    """P14 + J3: (uuid, model, ground_truth, gold_quotes, system_response) still to score.

    uuid, inference and gold must be non-empty; pairs with any stored score are skipped
    unless ``force`` (unlike the original, ``force`` really re-scores). With ``keep_skipped``
    they stay as rows with ``skipped`` = true and no response text, for the outcome counts.
    With ``judgments`` the columns recall, precision and judged are attached (T10 a).
    With ``parsed`` also what scoring takes from each text alone (``resp_quotes``, ``n_gold``,
    ``n_resp``, ``format_score``): it is computed once, before the join, so a summary that
    needs no text moves none.

    Every table is keyed by uuid alone: judgments and stored scores are first gathered to one
    narrow row per uuid, so inferences are scanned once and their text is shuffled once, with
    any session settings, and each side can be broadcast or skew-split by the planner.
    """
    # plainly not '' (so not NULL): a column made by an expression is computed anew for each time it is named
    ts = testset.where((F.col("uuid") != "") & (F.col("quotes") != ""))
    if uuid:
        ts = ts.where(F.col("uuid") == uuid)
        inferences = inferences.where(F.col("uuid") == uuid)
    inf = inferences.select("uuid", "model", F.col("quotes").alias("system_response")).where(
        (F.col("system_response") != "") & (F.col("uuid") != "")
    )
    texts = ["ground_truth", "gold_quotes", "system_response"]
    gold = gold_side(ts)
    if parsed:
        inf = inf.withColumn("resp_quotes", parse_quotes("system_response")).withColumns(
            {"n_resp": F.size("resp_quotes"), "format_score": format_score("system_response")})
        gold = gold.withColumn("n_gold", F.size("gold_quotes"))
        texts += ["resp_quotes", "n_gold", "n_resp", "format_score"]
    if models is not None:
        inf = inf.join(models.select("model").distinct(), "model", "left_semi")
    pairs = inf.join(gold, "uuid")
    skipped = F.lit(False)
    if prior_scores is not None and not force:
        pairs = pairs.join(_by_uuid(prior_scores, "_prior"), "uuid", "left")
        skipped = _entry("_prior").isNotNull()
    if judgments is not None:
        j = judgments.select("uuid", "model", F.col("recall").cast("double").alias("recall"),
                             F.col("precision").cast("double").alias("precision"))
        pairs = pairs.join(_by_uuid(j, "_judged", "recall", "precision"), "uuid", "left")
    pairs = pairs.withColumn("skipped", skipped)
    if not keep_skipped:
        pairs = pairs.where(~F.col("skipped"))
    cols = [F.when(~F.col("skipped"), F.col(c)).alias(c) for c in texts]
    if judgments is not None:
        e = _entry("_judged")
        cols += [e["recall"].alias("recall"), e["precision"].alias("precision"), e.isNotNull().alias("judged")]
    return pairs.select("uuid", "model", *cols, *(["skipped"] if keep_skipped else []))


def measured_samples(samples: DataFrame) -> DataFrame:
    """``samples`` with what scoring takes from their texts (``n_gold``, ``n_resp``, ``format_score``,
    ``_bm25``) in place of the texts: a judgment that is joined afterwards moves none."""
    s = samples.withColumn("gold_quotes", parse_quotes("ground_truth")).withColumn("resp_quotes", parse_quotes("system_response"))
    s = s.withColumns({"n_gold": F.size("gold_quotes"), "n_resp": F.size("resp_quotes"), "format_score": format_score("system_response")})
    s = bm.add_bm25(s, "gold_quotes", "resp_quotes", out="_bm25")
    return s.drop("ground_truth", "system_response", "gold_quotes", "resp_quotes")


def score_samples(samples: DataFrame, judgments: DataFrame | None = None, judge: str = "table",
                  threshold: float = 0.5) -> DataFrame:
    """T11 + T12: judge, repair, F1, BM25 and format for every sample.

    Columns that ``evaluation_samples(parsed=True)`` or :func:`measured_samples` adds are taken as they are. A sample that carries ``judged`` (with recall and precision) keeps its judgment: from
    :func:`evaluation_samples`, ``callable_judge`` or a judgments table joined before.

    status: ``skipped`` (rows marked so: no metric); ``scored``; ``judge_error`` (no judgment: recall/precision/F1 NULL, BM25 and
    format kept); ``crash`` (a NULL recall or precision survives the repair, so F1
    cannot be computed: every metric NULL). Only ``scored`` rows are stored (S13).
    """
    s = samples
    measured = "_bm25" in s.columns
    if not measured and "gold_quotes" not in s.columns:
        s = s.withColumn("gold_quotes", parse_quotes("ground_truth"))
    if not measured and "resp_quotes" not in s.columns:
        s = s.withColumn("resp_quotes", parse_quotes("system_response"))
    ng, nr, fmt = (F.col(c) if c in s.columns else made for c, made in (
        ("n_gold", F.size("gold_quotes")), ("n_resp", F.size("resp_quotes")), ("format_score", format_score("system_response"))))
    if "judged" in s.columns:
        pass
    elif judge == "table":
        if judgments is None:
            raise ValueError("judge='table' needs a judgments DataFrame")
        s = judge_from_table(s, judgments)
    elif judge == "lexical":
        s = lexical_judge(s, "gold_quotes", "resp_quotes", threshold)
    else:
        raise ValueError(f"unknown judge {judge!r}")
    if not measured:
        s = bm.add_bm25(s, "gold_quotes", "resp_quotes", out="_bm25")
    s = s.withColumn("precision", repair_precision("recall", "precision", ng, nr))
    judged = F.col("judged")
    crash = judged & (F.col("recall").isNull() | F.col("precision").isNull())
    skipped = F.col("skipped") if "skipped" in s.columns else F.lit(False)
    status = (
        F.when(skipped, F.lit(STATUS_SKIPPED))
        .when(~judged, F.lit(STATUS_JUDGE_ERROR))
        .when(crash, F.lit(STATUS_CRASH))
        .otherwise(F.lit(STATUS_SCORED))
    )
    ok = status == STATUS_SCORED
    kept = ~status.isin(STATUS_CRASH, STATUS_SKIPPED)
    null = F.lit(None).cast("double")
    return s.select(
        "uuid",
        "model",
        status.alias("status"),
        F.when(ok, F.col("recall")).otherwise(null).alias("recall"),
        F.when(ok, F.col("precision")).otherwise(null).alias("precision"),
        F.when(ok, f1("precision", "recall")).otherwise(null).alias("f1"),
        F.when(kept, F.col("_bm25")).otherwise(null).alias("bm25"),
        F.when(kept, fmt).otherwise(null).alias("format_score"),
    )


def stored_scores(results: DataFrame) -> DataFrame:
    """Rows that go to the score table (S13 input): ``scored`` only."""
    return results.where(F.col("status") == STATUS_SCORED).select("uuid", "model", *SCORE_COLUMNS)


def manual_scores(manual: DataFrame, testset: DataFrame, inferences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recompute BM25/format/F1 for manual (recall, precision) items.

    Items without uuid/model, document or non-empty inference are skipped; recall,
    precision and F1 are rounded to 4 places but not clamped; no repair; for repeated
    (uuid, model) the greatest ``ord`` wins. Returns (score rows, applied-item count
    as a one-row DataFrame): every applied item counts, repeats included.
    """
    items = manual.where(nz("uuid").isNotNull() & nz("model").isNotNull())
    items = items.withColumn("recall", F.coalesce(F.col("recall").cast("double"), F.lit(0.0))).withColumn(
        "precision", F.coalesce(F.col("precision").cast("double"), F.lit(0.0))
    )
    docs = testset.select("uuid", F.col("quotes").alias("ground_truth"))
    inf = inferences.select("uuid", "model", F.col("quotes").alias("system_response")).where(
        nz("system_response").isNotNull()
    )
    # winners are chosen among the narrow items; texts are joined to them afterwards
    narrow = items.select("uuid", "model", "ord", "recall", "precision")
    winner = narrow.groupBy("uuid", "model").agg(
        F.max(F.struct("ord", "recall", "precision")).alias("w"), F.count(F.lit(1)).alias("n")
    ).select("uuid", "model", "n", "w.ord", "w.recall", "w.precision")
    count = winner.join(docs.select("uuid"), "uuid", "left_semi").join(
        inf.select("uuid", "model"), ["uuid", "model"], "left_semi"
    ).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("updated"))
    latest = winner.drop("n").join(docs, "uuid").join(inf, ["uuid", "model"])
    latest = latest.withColumn("gold_quotes", parse_quotes("ground_truth")).withColumn(
        "resp_quotes", parse_quotes("system_response")
    )
    latest = bm.add_bm25(latest, "gold_quotes", "resp_quotes")
    rows = latest.select(
        "uuid",
        "model",
        round_half_up("recall", 4).alias("recall"),
        round_half_up("precision", 4).alias("precision"),
        round_half_up(f1("precision", "recall"), 4).alias("f1"),
        "bm25",
        format_score("system_response").alias("format_score"),
    )
    return rows, count
