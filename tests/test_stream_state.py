"""Keyed scoring stream against the batch result, folding of logs, last-wins on narrow keys."""

import os

import pytest
from conftest import quotes
from pyspark.sql import functions as F

from evidence_spark.operators import scoring as sc
from evidence_spark.operators.keyed import last_wins
from evidence_spark.streaming import ingest, keyed

LOG = "file string, pos bigint, uuid string, model string, quotes string"
JUDGED = "uuid string, model string, recall double, precision double"
GOLD = [(f"u{i}", quotes(f"alpha beta {i}", "gamma delta")) for i in range(6)] + [("empty", ""), ("null", None), ("bare", "no quotes")]


def _append(spark, log, batch, rows):
    spark.createDataFrame(rows, LOG).write.parquet(f"{log}/batch_id={batch}")


def test_keyed_scoring_equals_the_batch_result(spark, tmp_dir):
    """Five batches: answers that change, judgments before, with and long after them, and one that
    gives no score until it is replaced; the stream is started anew for each, the log folded once."""
    log, scores, said, ckpt = (f"{tmp_dir}/{n}" for n in ("log", "scores", "said", "ckpt"))
    testset = spark.createDataFrame(GOLD, "uuid string, quotes string")
    answers = [
        [("f", 0, "u0", "m", quotes("alpha beta 0")), ("f", 1, "u1", "m", quotes("x")), ("f", 2, "u1", "m", quotes("gamma delta")), ("f", 3, "nobody", "m", "q")],
        [("g", 0, "u2", "m", quotes("old")), ("g", 1, "u3", "m", ""), ("g", 2, "u4", "n", quotes("delta")), ("g", 3, "empty", "m", "q"), ("g", 4, "null", "m", "q")],
        [("h", 0, "u2", "m", quotes("alpha beta 2")), ("h", 1, "u3", "m", quotes("gamma")), ("h", 2, "u5", "m", None), ("h", 3, "bare", "m", "plain answer")],
        [("i", 0, "u0", "n", quotes("alpha")), ("i", 1, "u2", "m", quotes("alpha beta 2", "more"))],
        [("j", 0, "u5", "m", quotes("at last"))],
    ]
    judgments = [
        [("u0", "m", 1.0, 0.0), ("u3", "m", 0.5, 0.5), ("nobody", "m", 1.0, 1.0)],
        [("u1", "m", None, 1.0), ("u4", "n", 0.5, None)],
        [("bare", "m", 1.0, None)],
        [("u1", "m", 0.25, 1.0), ("u2", "m", 0.75, 0.0)],
        [("u5", "m", 0.0, 0.0), ("u0", "n", 0.1, float("nan")), ("bare", "m", 1.0, 0.5)],
    ]
    rows = []
    for n in range(5):
        _append(spark, log, n, answers[n])
        spark.createDataFrame(judgments[n], JUDGED).write.mode("append").parquet(said)
        run = keyed.start_scoring(spark, testset, log, scores, ckpt, judgment_dir=said)
        run.awaitTermination()
        rows.append(sum(p["numInputRows"] for p in run.recentProgress))
        if n == 2:
            ingest.compact_logs(spark, log, scores, 1)
    # input of a batch: its own rows (the test set is read for each stream too), once more a fold
    assert rows[1] < 40 and rows[4] < 40
    last = spark.createDataFrame([(u, m, r, p) for u, m, r, p in {(j[0], j[1]): j for b in judgments for j in b}.values()], JUDGED)
    batch = sc.score_samples(sc.evaluation_samples(testset, ingest.current_inferences(spark, log), judgments=last))
    want = sorted(map(str, sc.stored_scores(batch).collect()))
    assert sorted(map(str, ingest.current_scores(spark, scores).collect())) == want and len(want) == 8


def test_keyed_scoring_with_the_lexical_judge(spark, tmp_dir):
    log, scores, ckpt = (f"{tmp_dir}/{n}" for n in ("log", "scores", "ckpt"))
    testset = spark.createDataFrame(GOLD, "uuid string, quotes string")
    for n in range(2):
        _append(spark, log, n, [("f", i, f"u{i}", f"m{n}", quotes(f"alpha beta {i}")) for i in range(6)])
        keyed.start_scoring(spark, testset, log, scores, ckpt, max_files_per_trigger=1).awaitTermination()
    batch = sc.score_samples(sc.evaluation_samples(testset, ingest.current_inferences(spark, log)), judge="lexical")
    assert sorted(ingest.current_scores(spark, scores).collect()) == sorted(sc.stored_scores(batch).collect())


def _three(spark, log):
    for b, rows in enumerate([[("f", 0, "u1", "m", "a"), ("f", 1, "u2", "m", "b")], [("g", 0, "u1", "m", "c")], [("h", 0, "u3", "m", "d")]]):
        _append(spark, log, b, rows)
    return sorted(ingest.current_inferences(spark, log).collect())


def test_folding_keeps_the_current_tables(spark, tmp_dir):
    log = f"{tmp_dir}/log"
    before = _three(spark, log)
    ingest.compact_logs(spark, log, None, 9)
    assert sorted(ingest.current_inferences(spark, log).collect()) == before
    assert sorted(x for x in os.listdir(log) if x.startswith("batch")) == ["batch_id=2"]
    _append(spark, log, 3, [("k", 0, "u2", "m", "z")])
    ingest.compact_logs(spark, log, None, 9)
    assert os.listdir(f"{log}_folded") == ["upto=2"]
    now = {r["uuid"]: r["quotes"] for r in ingest.current_inferences(spark, log).collect()}
    assert now == {"u1": "c", "u2": "z", "u3": "d"}


def test_folding_that_dies_loses_nothing(spark, tmp_dir, monkeypatch):
    log = f"{tmp_dir}/log"
    before = _three(spark, log)
    real = ingest.last_wins

    def broken(df, keys, order, unique=False):
        return real(df, keys, order, unique).withColumn("quotes", F.when(F.col("uuid") == "u2", F.raise_error(F.lit("disk full"))).otherwise(F.col("quotes")))

    monkeypatch.setattr(ingest, "last_wins", broken)
    with pytest.raises(Exception, match="disk full"):
        ingest.compact_logs(spark, log, None, 1)
    monkeypatch.setattr(ingest, "last_wins", real)
    assert sorted(ingest.current_inferences(spark, log).collect()) == before
    # dies between the commit of the fold and the removal of its batches
    files = ingest._filesystem
    monkeypatch.setattr(ingest, "_filesystem", lambda s, p: (_ for _ in ()).throw(OSError("gone")) if "batch_id=" in p else files(s, p))
    with pytest.raises(OSError):
        ingest.compact_logs(spark, log, None, 1)
    monkeypatch.setattr(ingest, "_filesystem", files)
    assert sorted(x for x in os.listdir(log) if x.startswith("batch")) == [f"batch_id={i}" for i in range(3)]
    assert sorted(ingest.current_inferences(spark, log).collect()) == before
    ingest.compact_logs(spark, log, None, 1)
    assert sorted(ingest.current_inferences(spark, log).collect()) == before
    assert [x for x in os.listdir(log) if x.startswith("batch")] == ["batch_id=2"]


def test_last_wins(spark):
    rows = [(None, 1, None, "a"), (None, 2, 0, "b"), ("k", None, 1, "c"), ("k", 3, None, None), ("t", 1, 1, "x"), ("t", 1, 1, "y"), ("t", 1, 1, "y"), ("n", None, None, "only")]
    df = spark.createDataFrame(rows, "k string, o int, p int, v string").repartition(3)
    got = {r["k"]: tuple(r) for r in last_wins(df, ["k"], ["o", "p"]).collect()}
    assert len(got) == last_wins(df, ["k"], ["o", "p"]).count() == 4
    assert got[None] == (None, 2, 0, "b") and got["k"] == ("k", 3, None, None) and got["n"][3] == "only" and got["t"][3] in ("x", "y")
    again = {r["k"]: tuple(r) for r in last_wins(df.orderBy(F.rand()), ["k"], ["o", "p"]).collect()}
    assert again == got
    assert last_wins(df.limit(0), ["k"], ["o"]).count() == 0


def test_last_wins_aggregates_no_texts(spark, tmp_dir):
    """With a unique order no aggregation of the executed plan carries the text column."""
    spark.range(1000).selectExpr("cast(id % 300 as string) AS k", "id AS o", "repeat('x', 50) AS v").write.parquet(f"{tmp_dir}/t")
    out = last_wins(spark.read.parquet(f"{tmp_dir}/t"), ["k"], ["o"], unique=True)
    assert len(out.collect()) == 300
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert not [x for x in final.split("\n") if "Aggregate" in x and "v#" in x]


def test_scoring_state_is_native_and_holds_no_text(spark, tmp_dir):
    """The state of a pair is a streaming aggregate of places and numbers: no Python call and no text for a key."""
    log, said = f"{tmp_dir}/log", f"{tmp_dir}/said"
    os.makedirs(log), os.makedirs(said)
    testset = spark.createDataFrame(GOLD, "uuid string, quotes string")
    answers = spark.readStream.schema(ingest.LOG_SCHEMA).parquet(log)
    judgments = spark.readStream.schema(JUDGED).parquet(said)
    for j in (judgments, None):
        pairs = keyed.ready_pairs(answers, j, testset)
        plan = pairs._jdf.queryExecution().analyzed().toString()
        assert "Aggregate" in plan and "FlatMapGroups" not in plan and "TransformWithState" not in plan
        assert pairs.columns == ["uuid", "model", "batch_id", "file", "pos", "recall", "precision"]


def test_a_scored_pair_is_not_scored_again(spark, tmp_dir):
    """Later answers and judgments of a scored pair, and a batch of one answer file twice, change nothing."""
    log, scores, said, ckpt = (f"{tmp_dir}/{n}" for n in ("log", "scores", "said", "ckpt"))
    testset = spark.createDataFrame(GOLD, "uuid string, quotes string")
    for n, (answer, recall) in enumerate([("alpha beta 0", 0.5), ("other", 1.0), ("alpha", None)]):
        _append(spark, log, n, [("f", 0, "u0", "m", quotes(answer)), ("f", 1, "u0", "m", quotes(answer))])
        spark.createDataFrame([("u0", "m", recall, 0.5), ("u0", "m", 0.25, 0.5)], JUDGED).write.mode("append").parquet(said)
        keyed.start_scoring(spark, testset, log, scores, ckpt, judgment_dir=said).awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(scores).select("uuid", "model", "recall").collect()]
        assert got == [("u0", "m", 0.5)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_without_earlier_ones_equal_last_wins(spark, tmp_dir):
    """No, few and many overridden rows, in few and in many files: the rows of last_wins, and answers
    are shuffled only when they are many, then only those of the files they stand in."""
    from evidence_spark.operators.keyed import without_earlier

    schema = "batch_id long, file string, pos long, uuid string, model string, quotes string"
    rows = [(b, f"f{f}", p, f"u{p % 7}" if p != 5 else None, f"m{f}" if f else None, f"{b} {f} {p}") for b in range(3) for f in range(3) for p in range(9) if b < 2 or f == 1]
    for n, some in enumerate(([r for r in rows if r[0] == 0 and r[2] < 7], rows)):
        path = f"{tmp_dir}/{n}"
        spark.createDataFrame(some, schema).repartition(3).write.parquet(path)
        log = spark.read.schema(schema).parquet(path)
        keys, order = ["uuid", "model"], ["batch_id", "file", "pos"]
        want = sorted(map(str, last_wins(log, keys, order, unique=True).select(*log.columns).collect()))
        for limit in (1000, 7, 0):
            got = without_earlier(log, keys, order, rows=limit)
            assert sorted(map(str, got.collect())) == want
            if n == 0 or limit == 1000:
                assert "Exchange hashpartitioning" not in _plan(got)
    assert len(want) == 21


def test_answers_of_unknown_documents_are_left_out_without_a_shuffle(spark):
    answers = spark.createDataFrame([("u1", "a"), ("u1", "b"), ("nobody", "c"), (None, "d"), ("u2", None)], "uuid string, quotes string")
    testset = spark.createDataFrame([("u1",), ("u2",), (None,)], "uuid string")
    for rows in (answers, answers.where("uuid <> 'nobody'")):
        got = ingest.of_known(rows, testset)
        assert sorted(map(str, got.collect())) == sorted(map(str, answers.where("uuid IN ('u1', 'u2')").collect()))
        assert "hashpartitioning" not in _plan(got)


def test_answers_to_be_scored_are_shuffled_once(spark, tmp_dir):
    """Without broadcasts every table is dealt by uuid alone, so no join deals the texts anew; an answer is found by its place."""
    tables = {
        "ready": ([("u1", "m", 1, "f", 0, 1.0, 0.5), ("u1", "n", 2, "g", 3, 0.0, None), ("u2", "m", 1, "f", 9, 0.5, 0.5)],
                  "uuid string, model string, batch_id bigint, file string, pos bigint, recall double, precision double"),
        "said": ([("u1", "m", 1, "f", 0, "a"), ("u1", "m", 1, "f", 5, "other place"), ("u1", "n", 2, "g", 3, "b"), ("u1", None, 2, "g", 3, "no model"),
                  ("u2", "m", 1, "f", 9, "c"), ("u3", "m", 1, "f", 1, "not ready")],
                 "uuid string, model string, batch_id bigint, file string, pos bigint, system_response string"),
        "testset": ([("u1", "g1"), ("u3", "g3")], "uuid string, quotes string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_dir}/{name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = keyed.answered_pairs(*(spark.read.parquet(f"{tmp_dir}/{name}") for name in tables))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(uuid#") == 3
        assert sorted(map(tuple, out.select("uuid", "model", "system_response", "recall", "precision", "ground_truth").collect())) == [
            ("u1", "m", "a", 1.0, 0.5, "g1"), ("u1", "n", "b", 0.0, None, "g1")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
