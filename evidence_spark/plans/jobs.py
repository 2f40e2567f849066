"""Composed jobs: each chains operators into one plan and writes once.

Paths are always arguments. Outputs are new snapshot folders: a job never overwrites
a path it reads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.operators import curate as cu
from evidence_spark.operators import report as rp
from evidence_spark.operators import scoring as sc
from evidence_spark.operators.judge import ask_judge, staged_pairs, with_answers
from evidence_spark.session import scratch_path
from evidence_spark.sources import corpus as src
from evidence_spark.sources import inferences as inf_src
from evidence_spark.sources import scores as score_src


def corpus_split_key(df: DataFrame) -> DataFrame:
    """Partition column for the corpus table ('' would read back as NULL)."""
    return df.withColumn("split_key", F.when(F.col("split") == "", F.lit("_")).otherwise(F.col("split")))


def write_corpus(corpus: DataFrame, path: str) -> None:
    corpus_split_key(corpus).write.mode("overwrite").partitionBy("split_key").parquet(path)


def read_corpus(spark: SparkSession, path: str, split: str = "") -> DataFrame:
    """S4 over a written corpus table: the split filter prunes partitions."""
    df = spark.read.parquet(path)
    if split:
        df = df.where(F.col("split_key") == split).where(F.col("split") == split)
    return df.drop("split_key")


def curated_export(corpus: DataFrame, out_path: str | None = None, fmt: str = "parquet",
                   template: str = cu.DEFAULT_CONVERSATION_TEMPLATE) -> DataFrame:
    """S4 -> P1 -> P5 -> P4 -> P6 -> S14."""
    out = cu.export_records(corpus, template)
    if out_path:
        src.write_dataset(out, out_path, fmt)
    return out


def add_ids(dataset: DataFrame, splits, out_path: str | None = None, mode: str = "stable") -> DataFrame:
    """S8 -> P10 -> S14."""
    out = cu.assign_ids(dataset, splits, mode=mode)
    if out_path:
        out.withColumn("target_split", F.col("split")).write.mode("overwrite").partitionBy("target_split").parquet(out_path)
    return out


@dataclass
class TestsetResult:
    testset: DataFrame
    inferences: DataFrame | None
    scores: DataFrame | None
    upserted: DataFrame


def build_testset(published: DataFrame, splits, current: DataFrame | None = None,
                  inferences: DataFrame | None = None, scores: DataFrame | None = None, *,
                  order: list[str], unique_order: bool = False) -> TestsetResult:
    """S8 -> P9 -> S7 -> S9 (whole-record replace; replaced uuids lose children)."""
    records = cu.test_records(published, splits, keep=order)
    t, i, s, n = score_src.upsert_testset(current, records, inferences, scores, order=order, unique_order=unique_order)
    return TestsetResult(t, i, s, n)


def update_inferences(spark: SparkSession, data_dir: str, testset: DataFrame,
                      current: DataFrame | None = None) -> DataFrame:
    """C4 (batch): S10 -> L2 -> J2."""
    return inf_src.attach_inferences(testset, current, inf_src.read_inference_files(spark, data_dir))


@dataclass
class EvaluationResult:
    results: DataFrame          # one row per pair, with status (skipped pairs too)
    scores: DataFrame           # score table after the upsert (S13)
    summary: DataFrame          # A3 + A4 + A5 + A11 counts per model
    outcomes: DataFrame         # A11 (model, status, n)
    counts: dict[str, int]      # A11 over all models, counted while the results were written
    models: DataFrame           # J5 (ord, model)
    candidates: DataFrame       # A7 (one row: count)


def evaluate(spark: SparkSession, testset: DataFrame, inferences: DataFrame, judgments: DataFrame | None = None,
             judge: str | Callable = "table", prior_scores: DataFrame | None = None, models: list[str] | None = None,
             uuid: str | None = None, force: bool = False, results_path: str | None = None,
             judgments_path: str | None = None, parallelism: int | None = None, judge_chunks: int = 16,
             judge_options: dict | None = None) -> EvaluationResult:
    """S12 -> A6/J5 -> P14/J3 -> T10 -> T11 -> T12 -> S13, then A3-A5, A7, A11.

    All models in one plan. ``judge`` is ``table`` (``judgments``), ``lexical``, or a function
    that makes a judge (see ``callable_judge``): its answers are saved under
    ``judgments_path`` as they come, so a run that is started again asks only for the rest.
    ``judge_options`` are its calls in flight, retries and pace.

    The per-pair results are written once, to ``results_path`` or a fresh folder under the
    shared checkpoint folder, and read back: they feed the score table and every summary.
    """
    cands = sc.candidate_documents(testset, inferences, uuid)
    chosen = sc.select_models(spark, sc.available_models(cands, inferences), models)
    samples = sc.evaluation_samples(testset, inferences, prior_scores, models=chosen if models else None, uuid=uuid,
                                    force=force, judgments=judgments if judge == "table" else None, keep_skipped=True,
                                    parsed=not callable(judge))
    if callable(judge):
        path = judgments_path or scratch_path(spark, "judgments")
        # texts are stored once; what scoring takes from them is computed where they are read, and answers meet numbers
        samples = staged_pairs(samples.select("uuid", "model", "ground_truth", "system_response", "skipped"), judge_chunks)
        answers = ask_judge(samples.where(~F.col("skipped")), judge, path, parallelism, judge_chunks, **(judge_options or {}))
        samples = with_answers(sc.measured_samples(samples.drop("chunk")), answers)
    elif judge == "table" and judgments is None:
        raise ValueError("judge='table' needs a judgments DataFrame")
    results = sc.score_samples(samples, judge=judge if isinstance(judge, str) else "table")
    path = results_path or scratch_path(spark, "results")
    counted, seen = rp.counted_while_written(results)
    counted.write.mode("overwrite").parquet(path)
    results = spark.read.schema(results.schema).parquet(path)
    return EvaluationResult(
        results=results,
        scores=score_src.write_scores(prior_scores, sc.stored_scores(results)),
        summary=rp.evaluation_summary(results),
        outcomes=rp.outcome_counts(results),
        counts={o: seen.get[o] for o in rp.OUTCOMES},
        models=chosen,
        candidates=rp.candidate_count(cands),
    )


def model_report(scores: DataFrame, model: str | None = None) -> DataFrame:
    """S11 -> A1/A2 -> L1 (empty DataFrame = no results)."""
    return rp.model_report(scores, model)


def merge_dataset(existing: DataFrame, corpus: DataFrame, split: str | None = "train", n: int | None = None,
                  seed: int = 0, columns: str = "existing", out_path: str | None = None) -> DataFrame | None:
    """S8 -> A8 -> J1 -> P15 -> L3 -> P7 -> U1 -> P8 -> S14.

    Returns None (and writes nothing) when there is no novel sample.
    """
    novel = cu.novel_samples(corpus, cu.question_keys(existing), split)
    novel = cu.sample_exact(novel, n, seed, key_cols=["hf_id"] if "hf_id" in novel.columns else None)
    # the novel rows are computed once; the test and the merged table read what was written
    path = scratch_path(corpus.sparkSession, "novel")
    novel.write.parquet(path)
    novel = corpus.sparkSession.read.schema(novel.schema).parquet(path)
    if novel.isEmpty():
        return None
    merged = cu.add_samples(existing, cu.training_rows(novel), columns=columns)
    if out_path:
        merged.withColumn("target_split", F.col("split")).write.mode("overwrite").partitionBy("target_split").parquet(out_path)
    return merged


def manual_override(manual: DataFrame, testset: DataFrame, inferences: DataFrame,
                    scores: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """J4 job: recompute and upsert manual scores; returns (score table, applied count)."""
    rows, count = sc.manual_scores(manual, testset, inferences)
    return score_src.write_scores(scores, rows), count
