import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidence_spark.operators import curate as cu
from evidence_spark.operators import report as rp
from evidence_spark.plans import jobs
from evidence_spark.sources import corpus as src
from evidence_spark.sources import inferences as inf


def _write(path, obj, raw=None):
    with open(path, "w", encoding="utf-8") as f:
        f.write(raw if raw is not None else json.dumps(obj))


def test_corpus_files_and_validation(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "train.json"), [
        {"id": "a", "question": "q1", "context": "c", "answer": [{"text": "x"}, {"text": "y"}], "level": "easy",
         "quotes": "##begin_quote## z ##end_quote##"},
        {"id": "b", "question": None, "context": "c", "answer": "plain", "level": "hard"},
        {"id": "e", "question": "q", "context": "c", "answer": "plain", "level": "hard", "quotes": [{"text": "z"}]},
        {"id": "f", "question": "q", "context": "c", "answer": "plain", "level": "hard", "quotes": None},
    ])
    with open(os.path.join(tmp_dir, "validation.jsonl"), "w") as f:
        f.write('{"id": "g", "question": "q", "context": "c", "answer": "x", "level": "easy"}\n{"id": "h", "question"\n')
    _write(os.path.join(tmp_dir, "test.json"), [
        {"id": "c", "question": "q3", "context": "c", "answer": 5, "level": "hard"},
        {"id": "d", "question": 7, "context": "c", "answer": "x", "level": "hard"},
    ])
    raw = src.read_corpus_files(spark, tmp_dir)
    valid, bad = src.validate_corpus(raw)
    rows = {r["hf_id"]: r for r in valid.collect()}
    assert set(rows) == {"a", "c", "f", "g"}
    assert rows["a"]["answer"] == "xy" and rows["a"]["split"] == "train"
    assert rows["a"]["original_quotes"].startswith("##begin_quote##") and rows["a"]["quotes"] is None
    assert rows["c"]["answer"] == "5" and rows["c"]["split"] == "test"
    assert {r["hf_id"]: r["reason"] for r in bad.collect()} == {
        "b": "invalid: question", "d": "invalid: question", "e": "invalid: quotes", None: "invalid: record"}


def test_corpus_file_over_128_mib_keeps_every_record(spark, tmp_dir):
    n, context = 14_000, "x" * 10_000
    with open(os.path.join(tmp_dir, "train.json"), "w") as f:
        f.write("[" + ",\n".join(json.dumps({"id": f"d{i}", "question": "q", "context": context, "answer": "a", "level": "easy"})
                                 for i in range(n)) + "]")
    assert os.path.getsize(os.path.join(tmp_dir, "train.json")) > 128 << 20
    valid, bad = src.validate_corpus(src.read_corpus_files(spark, tmp_dir))
    assert valid.select("hf_id").distinct().count() == n and bad.count() == 0


def test_broken_inference_file_is_reported(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "m.json"), None, raw='{"u1": "a", "u2": ')
    _write(os.path.join(tmp_dir, "blank.json"), None, raw=" \n")
    files = inf.whole_inference_files(spark, tmp_dir)
    assert [r["path"].rpartition("/")[2] for r in inf.bad_inference_files(files).collect()] == ["m.json"]
    with pytest.raises(Exception, match="no JSON object"):
        inf.read_inference_files(spark, tmp_dir).collect()


def test_inference_lines_and_encoded_names(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "my model.json"), None, raw='{"u1":\n"a"}')
    with open(os.path.join(tmp_dir, "a+b 100%.jsonl"), "w") as f:
        f.write('{"uuid": "u1", "quotes": "x"}\n{"uuid": "u1", "quotes": "y"}\n')
    latest = {(r["uuid"], r["model"]): r["quotes"] for r in inf.latest_inferences(inf.read_inference_files(spark, tmp_dir)).collect()}
    assert latest == {("u1", "my model"): "a", ("u1", "a+b 100%"): "y"}


def test_equal_records_get_ids_of_their_own(spark):
    rows = [("q", None, "test"), ("q", None, "test"), ("q", "", "test"), ("r", "x", "train")]
    df = spark.createDataFrame(rows, "question string, quotes string, split string")
    ids = [r["uuid"] for r in cu.assign_ids(df, ["test"]).where("split = 'test'").collect()]
    assert len(set(ids)) == 3 and None not in ids
    again = [r["uuid"] for r in cu.assign_ids(df.repartition(3), ["test"]).where("split = 'test'").collect()]
    assert sorted(ids) == sorted(again)
    recs = cu.test_records(df, ["test"]).collect()
    assert len({r["uuid"] for r in recs}) == 3


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["A", " a", "b ", "B", "", "  ", "c"]), max_size=8), st.lists(st.sampled_from(["a", " B", "", "x"]), max_size=4))
def test_novel_questions_meet_no_existing_key(spark, corpus, existing):
    c = spark.createDataFrame([(q, "train") for q in corpus], "question string, split string")
    e = spark.createDataFrame([(q,) for q in existing], "question string")
    novel = [r["question"] for r in cu.novel_samples(c, cu.question_keys(e), "train").collect()]
    old = {q.strip().lower() for q in existing if q}
    assert sorted(novel) == sorted(q for q in corpus if q.strip() and q.strip().lower() not in old)


def test_resume_after_scores_are_stored_has_nothing_left(spark):
    gold = "##begin_quote## the cat sat ##end_quote##"
    ts = spark.createDataFrame([("u1", "q", "a", "c", gold)], "uuid string, question string, answer string, context string, quotes string")
    i = spark.createDataFrame([("u1", "m", gold), ("u1", "n", "x")], "uuid string, model string, quotes string")
    ev = jobs.evaluate(spark, ts, i, judge="lexical")
    second = jobs.evaluate(spark, ts, i, judge="lexical", prior_scores=ev.scores)
    assert {r["status"]: r["n"] for r in second.outcomes.where("model = 'm'").collect()} == {"skipped": 1}
    assert second.results.where("status <> 'skipped'").count() == 0
    assert sorted(second.scores.collect()) == sorted(ev.scores.collect())


def test_published_comparison(spark):
    rows = [("recall", "before", 48.3), ("recall", "after", 68.0), ("precision", "before", 43.6), ("precision", "after", 71.0),
            ("f1", "before", 41.3), ("f1", "after", 69.1), ("1B", "before", 24.4), ("1B", "after", 62.2),
            ("3B", "before", 57.7), ("3B", "after", 83.0), ("3.5", "before", 75.8), ("3.5", "after", 88.5)]
    df = spark.createDataFrame(rows, "what string, setting string, value double")
    got = {r["what"]: r["improvement"] for r in rp.compare_settings(df, ["what"], "setting", "value", "before", "after").collect()}
    assert got == {"recall": 19.7, "precision": 27.4, "f1": 27.8, "1B": 37.8, "3B": 25.3, "3.5": 12.7}

def test_missing_dataset_is_empty(spark, tmp_dir):
    df = src.read_table(spark, os.path.join(tmp_dir, "nope"), "question string, split string")
    assert df.count() == 0 and df.columns == ["question", "split"]


def test_inference_files_last_wins_and_model_names(spark, tmp_dir):
    d = os.path.join(tmp_dir, "inf")
    os.makedirs(d)
    _write(os.path.join(d, "qwen2.5-3b.json"), None, raw='{"u1": "a", "u2": "x", "u2": "z", "u3": null, "zz": "q"}')
    _write(os.path.join(d, "zmodel.json"), {"u1": "b"})
    long = inf.read_inference_files(spark, d)
    latest = {(r["uuid"], r["model"]): r["quotes"] for r in inf.latest_inferences(long).collect()}
    assert latest[("u2", "qwen2.5-3b")] == "z"
    assert ("u3", "qwen2.5-3b") in latest and latest[("u3", "qwen2.5-3b")] is None
    testset = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "uuid string")
    attached = inf.attach_inferences(testset, None, long)
    assert {r["uuid"] for r in attached.collect()} == {"u1", "u2", "u3"}
    assert inf.read_inference_files(spark, os.path.join(tmp_dir, "empty")).count() == 0


def test_append_batch_rejects_duplicates(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    b1 = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert src.append_batch(b1, None, ["k"], path) == 2
    target = spark.read.parquet(path)
    dup = spark.createDataFrame([("a", 3)], "k string, v int")
    try:
        src.append_batch(dup, target, ["k"], path)
        raise AssertionError("duplicate accepted")
    except ValueError:
        pass
    assert src.append_batch(spark.createDataFrame([], "k string, v int"), target, ["k"], path) == 0


def test_upsert_twice_equals_once(spark):
    pub = spark.createDataFrame([("q", "a", "c", "x", "test", "u1", 1), ("q2", "a", "c", "y", "test", None, 2)],
                                "question string, answer string, context string, quotes string, split string, uuid string, o int")
    current = spark.createDataFrame([("u1", "old", "a", "c", "z"), ("u9", "k", "a", "c", "z")],
                                    "uuid string, question string, answer string, context string, quotes string")
    once = jobs.build_testset(pub, ["test"], current=current, order=["o"]).testset
    twice = jobs.build_testset(pub, ["test"], current=once, order=["o"]).testset
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r["uuid"]: r["question"] for r in once.collect()}["u1"] == "q"


def test_sample_exact_is_repeatable(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a = [r.k for r in cu.sample_exact(df, 10, seed=3).collect()]
    b = [r.k for r in cu.sample_exact(df, 10, seed=3).collect()]
    assert a == b and len(set(a)) == 10
    assert cu.sample_exact(df, 1000, seed=3).count() == 100
    assert cu.sample_exact(df, None).count() == 100


def test_template_keeps_braces(spark):
    df = spark.createDataFrame([("what is {context}?", "ctx")], "question string, context string")
    out = df.select(cu.conversation(gold=F.lit("g")).alias("c")).first()["c"][0]["content"]
    assert "what is {context}?" in out and "ctx" in out


def test_random_ids_are_stable_after_checkpoint(spark):
    df = spark.createDataFrame([("a", "test"), ("b", "train")], "question string, split string")
    out = cu.assign_ids(df, ["test"], mode="random")
    first = {r["question"]: r["uuid"] for r in out.collect()}
    second = {r["question"]: r["uuid"] for r in out.collect()}
    assert first == second and first["b"] is None and len(first["a"]) == 36


def test_a_model_is_read_from_a_folder_of_parts(spark, tmp_dir):
    from evidence_spark.plans.queries_more import _FOLDERS, _inference_files

    rows = spark.range(30, numPartitions=3).selectExpr("to_json(named_struct('uuid', concat('u', id), 'quotes', 'q')) AS value")
    rows.write.text(os.path.join(tmp_dir, "a b+c.1.jsonl"))
    got = inf.read_inference_files(spark, tmp_dir)
    assert got.select("file").distinct().count() == 3 and got.count() == 30
    assert {r["model"] for r in got.select("model").distinct().collect()} == {"a b+c.1"}
    # the queries' files: a table of several parts is not gathered into one file
    many = os.path.join(tmp_dir, "sf")
    for name in os.listdir("/root/testdata/sf0.001"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}").repartition(3).write.parquet(os.path.join(many, name))
    with_max = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        read = inf.read_inference_files(spark, _inference_files(spark, many))
        files = {r["model"]: r["n"] for r in read.groupBy("model").agg(F.countDistinct("file").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_max)
    assert set(files) == set(_FOLDERS.values()) and len(files) == 7 and min(files.values()) > 1


def test_attached_answers_are_moved_once(spark, tmp_dir):
    """Of two answers the last counts, unknown uuids are left out, and the texts are joined once, to their winners."""
    rows = [("f", 0, "u1", "m", "old"), ("f", 1, "u1", "m", "new"), ("f", 2, "zz", "m", "q"), ("g", 0, "u2", "m", None), ("g", 1, None, "m", "q")]
    spark.createDataFrame(rows, inf.EMPTY_LONG).write.parquet(f"{tmp_dir}/long")
    spark.createDataFrame([("u1",), ("u2",), (None,)], "uuid string").write.parquet(f"{tmp_dir}/testset")
    out = inf.attach_inferences(spark.read.parquet(f"{tmp_dir}/testset"), None, spark.read.parquet(f"{tmp_dir}/long"))
    assert sorted(map(tuple, out.collect())) == [("u1", "m", "new"), ("u2", "m", None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")


def test_answers_of_pairs_that_stand_once_are_not_shuffled(spark, tmp_dir):
    """Only narrow rows, and current answers of models that the files name, go through a shuffle."""
    rows = [("f", k, f"u{k}", "m", f"t{k}") for k in range(6)] + [("f", 9, "zz", "m", "q"), ("f", 10, None, "m", "q")]
    spark.createDataFrame(rows, inf.EMPTY_LONG).write.parquet(f"{tmp_dir}/long")
    spark.createDataFrame([(f"u{k}",) for k in range(5)] + [(None,)], "uuid string").write.parquet(f"{tmp_dir}/testset")
    old = [("u1", "m", "old"), ("u5", "m", "kept"), ("u1", "x", "other"), ("u9", None, "n"), (None, "m", "nobody"), ("u1", "m", "twice")]
    spark.createDataFrame(old, "uuid string, model string, quotes string").write.parquet(f"{tmp_dir}/current")
    read = lambda name: spark.read.parquet(f"{tmp_dir}/{name}")
    fresh = inf.attach_inferences(read("testset"), None, read("long"))
    assert "Exchange hashpartitioning" not in fresh._jdf.queryExecution().executedPlan().toString()
    new = [(f"u{k}", "m", f"t{k}") for k in range(5)]
    assert sorted(map(tuple, fresh.collect())) == new
    out = inf.attach_inferences(read("testset"), read("current"), read("long"))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, new + [r for r in old if r[:2] != ("u1", "m")]))
    # many repeated pairs: the shuffled form gives the same
    twice = read("long").unionByName(read("long").where("pos < 3").selectExpr("'g' AS file", "pos", "uuid", "model", "'last' AS quotes")).localCheckpoint()
    counts = inf.pair_counts(twice)
    some, all_ = (sorted(map(tuple, inf.latest_inferences(twice, read("testset"), counts, rows=n).collect())) for n in (100, 0))
    assert some == all_ == sorted([(f"u{k}", "m", "last" if k < 3 else f"t{k}") for k in range(5)])
