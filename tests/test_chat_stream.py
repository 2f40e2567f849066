import json
import os
import uuid

import pytest

from evidence_spark.operators import chat as ch
from evidence_spark.operators import scoring as sc
from evidence_spark.operators.judge import callable_judge, saved_judgments
from evidence_spark.plans import jobs
from evidence_spark.sources import inferences as inf
from evidence_spark.streaming import ingest

S, E = "<|im_start|>", "<|im_end|>"


def test_chat_render_golden(spark):
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello"),
        (2, 0, "user", "Q"), (2, 1, "assistant", "A"), (2, 2, "user", "Q2"),
        (3, 0, "user", "run"), (3, 1, "tool", "42"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["rendered"] for r in ch.render_conversations(df).collect()}
    assert got[1] == f"{S}system\n\nBe brief.{E}\n{S}user\nHi{E}\n{S}assistant\nHello"
    assert got[2] == f"{S}user\nQ{E}\n{S}assistant\nA{E}\n{S}user\nQ2{E}\n{S}assistant\n"
    assert got[3] == f"{S}user\nrun{E}\n{S}user\n<tool_response>\n42\n</tool_response>{E}\n{S}assistant\n"


def test_chat_thinking_and_tool_calls(spark):
    rows = [(1, 0, "user", "x", None, None), (1, 1, "assistant", "", "hmm", [("f", '{"a": 1}')])]
    df = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string, thinking string, "
              "tool_calls array<struct<name:string, arguments:string>>")
    got = ch.render_conversations(df, think=True).first()["rendered"]
    assert got == (f"{S}user\nx{E}\n{S}assistant\n<think>hmm</think>\n<tool_call>\n"
                   '{"name": "f", "arguments": {"a": 1}}\n</tool_call>')


def _testset(spark):
    gold = "##begin_quote## the cat sat ##end_quote##"
    return spark.createDataFrame([("u1", "q", "a", "c", gold), ("u2", "q", "a", "c", gold)],
                                 "uuid string, question string, answer string, context string, quotes string")


def test_stream_ingest_equals_batch_and_scores(spark, tmp_dir):
    watch = os.path.join(tmp_dir, "watch")
    os.makedirs(watch)
    with open(os.path.join(watch, "m1.json"), "w") as f:
        json.dump({"u1": "##begin_quote## the cat sat ##end_quote##", "u2": "", "zz": "x"}, f)
    with open(os.path.join(watch, "m2.json"), "w") as f:
        json.dump({"u1": "##begin_quote## dog ##end_quote##"}, f)
    ts = _testset(spark)
    log, scores = os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "scores")
    q = ingest.start_ingest(spark, watch, ts, log, os.path.join(tmp_dir, "ckpt"), score_log=scores, judge="lexical")
    q.awaitTermination()
    streamed = sorted(ingest.current_inferences(spark, log).collect())
    batch = sorted(inf.attach_inferences(ts, None, inf.read_inference_files(spark, watch)).collect())
    assert streamed == batch
    sc_rows = {(r["uuid"], r["model"]): r for r in ingest.current_scores(spark, scores).collect()}
    assert set(sc_rows) == {("u1", "m1"), ("u1", "m2")}  # empty inference not scored
    assert sc_rows[("u1", "m1")]["bm25"] == 1.0 and sc_rows[("u1", "m1")]["recall"] == 1.0
    # a second run over the same folder finds nothing new (checkpointed)
    q2 = ingest.start_ingest(spark, watch, ts, log, os.path.join(tmp_dir, "ckpt"), score_log=scores, judge="lexical")
    q2.awaitTermination()
    assert sorted(ingest.current_inferences(spark, log).collect()) == streamed


def test_live_model_averages(spark, tmp_dir):
    path = os.path.join(tmp_dir, "s")
    rows = [("u1", "m", 1.0, 0.5, 0.6, -1.0, 1.0), ("u2", "m", 0.0, None, 0.0, 0.5, 0.0)]
    schema = "uuid string, model string, recall double, precision double, f1 double, bm25 double, format_score double"
    spark.createDataFrame(rows, schema).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    q = (ingest.live_model_averages(stream).writeStream.outputMode("complete").format("memory")
         .queryName("live_test").option("checkpointLocation", os.path.join(tmp_dir, "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    r = spark.table("live_test").first()
    assert (r["avg_recall"], r["avg_precision"], r["avg_bm25"], r["count"]) == (0.5, 0.25, 0.25, 2)


def test_chat_tools_listing(spark):
    rows = [(1, 0, "system", "Be brief.", ['{"name": "f"}', '{"name": "g"}']), (1, 1, "user", "Hi", None),
            (2, 0, "user", "Hi", ['{"name": "f"}']), (3, 0, "user", "Hi", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tools array<string>")
    got = {r["conv_id"]: r["rendered"] for r in ch.render_conversations(df).collect()}
    tool = '\n{"type": "function", "function": {"name": "%s"}}'
    tail = f"{ch.TOOLS_TAIL}{E}\n{S}user\nHi{E}\n{S}assistant\n"
    assert got[1] == f"{S}system\n\nBe brief.{ch.TOOLS_HEAD}{tool % 'f'}{tool % 'g'}{tail}"
    assert got[2] == f"{S}system\n{ch.TOOLS_HEAD}{tool % 'f'}{tail}"
    assert got[3] == f"{S}user\nHi{E}\n{S}assistant\n"


def _samples(spark, n=1, *more):
    q = "##begin_quote## a ##end_quote##"
    return spark.createDataFrame([(f"u{i}", "m", q, q) for i in range(n)] + list(more),
                                 "uuid string, model string, ground_truth string, system_response string")


def test_callable_judge_marks_failures_and_asks_again(spark, tmp_dir):
    samples = _samples(spark, 1, ("bad", "m", "##begin_quote## a ##end_quote##", "boom"))

    def make_judge(broken=True):
        def judge(gt, resp):
            if resp == "boom" and broken:
                raise RuntimeError("judge down")
            return 1.0, 0.0
        return judge

    judged = callable_judge(samples, make_judge, f"{tmp_dir}/j", parallelism=2, chunks=2)
    out = {r["uuid"]: r for r in sc.score_samples(judged).collect()}
    assert out["u0"]["status"] == "scored" and out["u0"]["precision"] == 1.0  # repaired
    assert out["bad"]["status"] == "judge_error" and out["bad"]["recall"] is None
    assert out["bad"]["format_score"] == 0.0
    again = callable_judge(samples, lambda: make_judge(False), f"{tmp_dir}/j", chunks=2)
    assert {r["uuid"]: r["judged"] for r in again.collect()} == {"u0": True, "bad": True}


def test_killed_judge_run_resumes_without_asking_twice(spark, tmp_dir):
    """The job dies in the middle; the second run asks only for pairs without a saved answer."""
    calls, die = os.path.join(tmp_dir, "calls"), os.path.join(tmp_dir, "die")
    os.makedirs(calls)
    open(die, "w").close()
    samples = _samples(spark, 60)

    class Killed(BaseException):
        pass

    def make_judge():
        def judge(gt, resp):
            if os.path.exists(die) and len(os.listdir(calls)) >= 25:
                raise Killed()
            open(os.path.join(calls, uuid.uuid4().hex), "w").close()
            return 1.0, 1.0
        return judge

    path = f"{tmp_dir}/answers"
    with pytest.raises(Exception):
        callable_judge(samples, make_judge, path, parallelism=1, chunks=12)
    saved = saved_judgments(spark, path).count()
    asked = len(os.listdir(calls))
    assert 0 < saved <= asked < 60
    os.remove(die)
    out = callable_judge(samples, make_judge, path, parallelism=1, chunks=12)
    assert out.where("judged").count() == 60
    assert len(os.listdir(calls)) - asked == 60 - saved  # none of the saved ones again


def test_folders_of_lines_are_streamed_in_parts(spark, tmp_dir):
    watch, log, ckpt = (os.path.join(tmp_dir, n) for n in ("watch", "log", "ckpt"))
    rows = spark.range(40, numPartitions=4).selectExpr("to_json(named_struct('uuid', concat('u', id), 'quotes', concat('a\n', id))) AS value")
    rows.write.text(os.path.join(watch, "m 1.x.jsonl"))
    with open(os.path.join(watch, "m2.json"), "w") as f:
        json.dump({"u0": "whole", "nobody": "x"}, f)
    ts = spark.range(40).selectExpr("concat('u', id) AS uuid")
    for _ in range(2):
        ingest.start_ingest(spark, watch, ts, log, ckpt, max_files_per_trigger=3).awaitTermination()
    got = {(r["uuid"], r["model"]): r["quotes"] for r in ingest.current_inferences(spark, log).collect()}
    assert got == {("u0", "m2"): "whole", **{(f"u{i}", "m 1.x"): f"a\n{i}" for i in range(40)}}
    assert sorted(os.listdir(log)) == ["batch_id=0", "batch_id=1"]


def test_texts_of_a_called_judge_are_stored_once_and_meet_no_join(spark, tmp_dir):
    """The evaluation with a called judge: one table of texts, and only numbers beside the answers."""
    import glob

    from evidence_spark.operators.judge import ask_judge, staged_pairs, with_answers
    from evidence_spark.session import ensure_checkpoint_dir

    def make_judge():
        return lambda gt, resp: (len(resp) % 3 / 2, len(gt) % 3 / 2)

    q = "##begin_quote## %s ##end_quote##"
    ts = spark.createDataFrame([(f"u{i}", q % f"a b {i}") for i in range(30)] + [("none", None)], "uuid string, quotes string")
    inf = spark.createDataFrame([(f"u{i}", m, q % f"{m} a {i}") for i in range(30) for m in ("m1", "m2")] + [("u1", "m2", "twice"), ("none", "m1", "x")],
                                "uuid string, model string, quotes string")
    prior = spark.createDataFrame([("u0", "m1", 1.0, 1.0, 1.0, 1.0, 1.0)], "uuid string, model string, " + ", ".join(f"{c} double" for c in sc.SCORE_COLUMNS))
    at = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/*"
    before = set(glob.glob(at))
    ev = jobs.evaluate(spark, ts, inf, judge=make_judge, prior_scores=prior, parallelism=2, judge_chunks=3)
    assert sorted(p.split("/")[-1].rsplit("-", 1)[0] for p in set(glob.glob(at)) - before) == ["judge-pairs", "judgments", "results"]
    samples = sc.evaluation_samples(ts, inf, prior)
    judged = callable_judge(samples, make_judge, f"{tmp_dir}/a", parallelism=2, chunks=3)
    want = sorted(map(str, sc.score_samples(judged).collect()))
    assert sorted(map(str, ev.results.where("status <> 'skipped'").collect())) == want and len(want) == 60
    assert ev.counts["skipped"] == 1
    pairs = staged_pairs(samples.select("uuid", "model", "ground_truth", "system_response"), 3)
    answers = ask_judge(pairs, make_judge, f"{tmp_dir}/a", chunks=3)  # all answered: nothing is asked
    joined = with_answers(sc.measured_samples(pairs), answers)
    assert not {"ground_truth", "system_response", "gold_quotes", "resp_quotes"} & set(joined.columns)
    assert sorted(map(str, sc.score_samples(joined).collect())) == want
