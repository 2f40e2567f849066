"""Recall/precision judges (T10, X4). All stages return the same columns:
``recall``, ``precision`` (double, may be NULL) and ``judged`` (false = judge failure).

(a) ``judge_from_table``  - judgments produced elsewhere, joined by (uuid, model)
(b) ``lexical_judge``     - a lexical stand-in computed in Spark: two quotes match when
                            their token sets have Jaccard >= threshold or one contains
                            the other. This is a different measurement from a language
                            model judge; results are labelled ``judge='lexical'``.
(c) ``callable_judge``    - a user function called from Arrow batches (``mapInPandas``),
                            the client built once per partition; answers are saved in
                            chunks, and a restart judges only pairs without an answer.
"""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.operators.bm25 import QuoteBlock, quote_blocks, quote_lists
from evidence_spark.session import scratch_path


def judge_from_table(samples: DataFrame, judgments: DataFrame, keys=("uuid", "model")) -> DataFrame:
    """(a) Left join of judgments (unique on ``keys``); missing row = judge failure."""
    keys = list(keys)
    j = judgments.select(
        *keys,
        F.col("recall").cast("double").alias("recall"),
        F.col("precision").cast("double").alias("precision"),
        F.lit(True).alias("judged"),
    )
    out = samples.join(j, keys, "left")
    return out.withColumn("judged", F.coalesce(F.col("judged"), F.lit(False)))


def lexical_judge(samples: DataFrame, gold_quotes: str, resp_quotes: str, threshold: float = 0.5) -> DataFrame:
    """(b) Recall and precision by token overlap of the two quote arrays of each row.

    Two quotes match when their distinct-token sets have Jaccard >= ``threshold`` or one
    contains the other. Candidates are pairs of quotes that share a token: a posting list of
    the row's golden tokens counts the common tokens of each pair, so quotes without one are
    never compared. Empty rules: no response quote -> precision 0, recall 1 if gold is empty
    too else 0; no gold quote -> recall 1, precision 0.
    """
    @F.arrow_udf("struct<recall:double,precision:double>")
    def judge(gold: pa.Array, response: pa.Array) -> pa.Array:
        out = []
        for golds, rows, responses in quote_blocks(quote_lists(gold), quote_lists(response)):
            if len(rows) > 1:
                out += _overlaps(golds, rows, responses, threshold)
            else:  # maybe larger than a group
                out.append(_overlap([set(q) for q in golds[0]], [set(q) for q in responses[0]], threshold))
        return pa.StructArray.from_arrays([pa.array([x[k] for x in out], pa.float64()) for k in (0, 1)], names=["recall", "precision"])

    out = samples.withColumn("_lex", judge(F.col(gold_quotes), F.col(resp_quotes)))
    return (
        out.withColumn("recall", F.col("_lex.recall"))
        .withColumn("precision", F.col("_lex.precision"))
        .withColumn("judged", F.lit(True))
        .drop("_lex")
    )


def _overlaps(golds: list, rows: list[int], responses: list, threshold: float) -> list[tuple[float, float]]:
    """:func:`_overlap` of a group of rows at once."""
    block = QuoteBlock(golds, rows, responses, distinct=True)
    order, _ = block.postings(block.term)
    asked, posting = block.meet(block.response)
    # common tokens of each (response quote, golden quote) of a row that share one
    entry, common = np.unique(block.quote[asked] * len(block.gold_length) + block.gold_quote[order][posting], return_counts=True)
    r, g = np.divmod(entry, max(len(block.gold_length), 1))
    x, y = block.gold_length[g], block.length[r]
    match = (common == x) | (common == y) | (common / (x + y - common) >= threshold)
    r, g = r[match], g[match]
    row_of = np.repeat(np.arange(len(rows)), np.diff(block.first))
    hit_response = np.bincount(row_of[np.unique(r)], minlength=len(rows)).tolist()
    # a golden quote is hit once in each row that holds it
    hit_gold = np.bincount(np.unique(row_of[r] * len(block.gold_length) + g) // max(len(block.gold_length), 1), minlength=len(rows)).tolist()
    out = []
    for k, (row, answers) in enumerate(zip(rows, responses)):
        n = len(golds[row])
        if not answers:
            out.append((0.0 if n else 1.0, 0.0))
        elif not n:
            out.append((1.0, 0.0))
        else:
            out.append((hit_gold[k] / n, hit_response[k] / len(answers)))
    return out


def _overlap(gold: list[set], response: list[set], threshold: float) -> tuple[float, float]:
    if not response:
        return (0.0 if gold else 1.0), 0.0
    if not gold:
        return 1.0, 0.0
    postings: dict[str, list[int]] = {}
    for k, q in enumerate(gold):
        for token in q:
            postings.setdefault(token, []).append(k)
    hit_gold, hit_response = set(), 0
    for r in response:
        common = Counter(k for token in r for k in postings.get(token, ()))
        matched = [k for k, i in common.items()
                   if i == len(gold[k]) or i == len(r) or i / (len(gold[k]) + len(r) - i) >= threshold]
        hit_gold.update(matched)
        hit_response += bool(matched)
    return len(hit_gold) / len(gold), hit_response / len(response)


JUDGE_SCHEMA = "uuid string, model string, recall double, precision double, judged boolean"


def saved_judgments(spark: SparkSession, path: str, chunk: int | None = None) -> DataFrame:
    """Answers stored so far under ``path`` (none: empty), of one chunk or all; one per (uuid, model).

    A pair answered in two attempts counts as judged if one of them succeeded.
    """
    try:
        rows = spark.read.schema(JUDGE_SCHEMA).parquet(f"{path.rstrip('/')}/chunk={'*' if chunk is None else chunk}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], JUDGE_SCHEMA)
    best = rows.groupBy("uuid", "model").agg(F.max(F.struct("judged", "recall", "precision")).alias("b"))
    return best.select("uuid", "model", "b.recall", "b.precision", "b.judged")


class _Pace:
    """Lets calls of all threads of a task start at most so often a second."""

    def __init__(self, per_second: float | None):
        self.gap, self.next, self.lock = (1 / per_second if per_second else 0.0), 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            at = max(self.next, time.monotonic())
            self.next = at + self.gap
        time.sleep(max(0.0, at - time.monotonic()))


def staged_pairs(samples: DataFrame, chunks: int) -> DataFrame:
    """``samples`` written once, dealt into ``chunks`` by a hash of (uuid, model), and read back
    with the column ``chunk``: what is asked of each chunk then reads that chunk alone."""
    spark = samples.sparkSession
    path = scratch_path(spark, "judge-pairs")
    dealt = samples.withColumn("chunk", F.pmod(F.xxhash64("uuid", "model"), F.lit(chunks)))
    dealt.write.option("compression", "zstd").partitionBy("chunk").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def ask_judge(
    pairs: DataFrame,
    make_judge: Callable[[], Callable[[str, str], tuple[float, float]]],
    path: str,
    parallelism: int | None = None,
    chunks: int = 16,
    in_flight: int = 1,
    retries: int = 0,
    backoff: float = 0.5,
    calls_per_second: float | None = None,
) -> DataFrame:
    """The answers (one per uuid and model) under ``path`` after asking for all ``pairs`` without one.

    ``pairs`` come from :func:`staged_pairs` with the same ``chunks``; the rest is as in
    :func:`callable_judge`. Texts are judged in the tasks that read them: they are shuffled only
    if ``parallelism`` asks for more tasks than a chunk has, or answers of an earlier run are left out.
    """
    spark = pairs.sparkSession
    src = pairs.select("uuid", "model", "ground_truth", "system_response", "chunk")

    def run(batches):
        judge = make_judge()
        pace = _Pace(calls_per_second)

        def ask(row):
            for attempt in range(retries + 1):
                pace.wait()
                try:
                    r, p = judge(row[2], row[3])
                    return (*row[:2], None if r is None else float(r), None if p is None else float(p), True)
                except Exception:  # judge failure is a row status, not a job failure
                    if attempt < retries:
                        time.sleep(backoff * 2 ** attempt)
            return (*row[:2], None, None, False)

        with ThreadPoolExecutor(max(1, in_flight)) as pool:
            for pdf in batches:
                rows = zip(pdf["uuid"], pdf["model"], pdf["ground_truth"], pdf["system_response"], strict=True)
                yield pd.DataFrame(list(pool.map(ask, rows)), columns=["uuid", "model", "recall", "precision", "judged"]).astype(
                    {"recall": "float64", "precision": "float64"})

    for chunk in range(chunks):
        done = saved_judgments(spark, path, chunk).where("judged").select("uuid", "model")
        part = src.where(F.col("chunk") == chunk).drop("chunk")
        tasks = part.rdd.getNumPartitions()  # of the scan
        if not done.isEmpty():
            part = part.join(done, ["uuid", "model"], "left_anti")
        if parallelism:
            part = part.coalesce(parallelism) if tasks >= parallelism else part.repartition(parallelism, "uuid", "model")
        part.mapInPandas(run, JUDGE_SCHEMA).write.mode("append").parquet(f"{path.rstrip('/')}/chunk={chunk}")
    return saved_judgments(spark, path)


def callable_judge(
    samples: DataFrame,
    make_judge: Callable[[], Callable[[str, str], tuple[float, float]]],
    path: str,
    parallelism: int | None = None,
    chunks: int = 16,
    in_flight: int = 1,
    retries: int = 0,
    backoff: float = 0.5,
    calls_per_second: float | None = None,
) -> DataFrame:
    """(c) Call ``make_judge()(ground_truth, system_response) -> (recall, precision)``.

    The judge is built once per partition. An exception for a row marks that row
    ``judged = false`` (the run goes on; a later run asks again). ``parallelism`` sets the
    number of concurrent tasks, ``in_flight`` that of the calls one task has open at a time
    (the judge must then stand being called from several threads). A call that fails is made
    again ``retries`` times, after ``backoff`` seconds, doubled each time. A task starts at
    most ``calls_per_second`` calls. Answers keep the order of their rows.

    Pairs are dealt into ``chunks`` by a hash of their key; each chunk's answers are committed
    to ``path/chunk=<n>`` before the next chunk starts, and a run leaves out the pairs that
    are already answered there. A failed job therefore loses the answers of one chunk at
    most; a task that is retried inside a chunk asks again for the rows of its partition.
    """
    # the pairs are computed once, not again for each chunk
    pairs = staged_pairs(samples.select("uuid", "model", "ground_truth", "system_response"), chunks)
    answers = ask_judge(pairs, make_judge, path, parallelism, chunks, in_flight, retries, backoff, calls_per_second)
    return with_answers(samples, answers)


def with_answers(samples: DataFrame, answers: DataFrame) -> DataFrame:
    """``samples`` with the saved answers: recall, precision and judged (false without one)."""
    return samples.join(answers, ["uuid", "model"], "left").withColumn("judged", F.coalesce(F.col("judged"), F.lit(False)))
