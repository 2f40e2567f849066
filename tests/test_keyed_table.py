"""Keyed tables: untouched buckets stay, lookups open few files; judge calls in flight; counts while writing."""

import glob
import os
import time

from conftest import quotes
from pyspark.sql import functions as F

from evidence_spark.operators import report as rp
from evidence_spark.operators import scoring as sc
from evidence_spark.operators.judge import callable_judge, saved_judgments
from evidence_spark.operators.keyed import upsert
from evidence_spark.plans import jobs
from evidence_spark.sources import keyed_table as kt

SCHEMA = "uuid string, model string, recall double"


def _rows(spark, n, value):
    return spark.range(n).selectExpr("concat('u', id) AS uuid", "concat('m', id % 3) AS model", f"{value} AS recall")


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/key_bucket=*/*.parquet")}


def test_upsert_leaves_other_buckets_alone(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    assert kt.read_table(spark, path, SCHEMA).count() == 0
    kt.upsert_table(_rows(spark, 500, "id / 2.0D"), path, buckets=16)
    old, before = kt.read_table(spark, path, SCHEMA).collect(), _files(path)
    new = spark.createDataFrame([("u7", "m1", -1.0), ("u9", "m0", None), ("fresh", "m0", 2.0), (None, "m0", 3.0)], SCHEMA)
    touched = kt.upsert_table(new, path, buckets=16)
    want = upsert(spark.createDataFrame(old, SCHEMA), new, ["uuid"])
    assert sorted(map(str, kt.read_table(spark, path, SCHEMA).collect())) == sorted(map(str, want.collect()))
    after = _files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert len(touched) <= 4 and {int(f.split("key_bucket=")[1].split("/")[0]) for f in before if f not in same} == set(touched)
    assert len(same) == 16 - len(touched) and kt.upsert_table(new.limit(0), path, buckets=16) == []
    # rows of a pair (uuid, model): those of other models stay
    kt.upsert_table(spark.createDataFrame([("u7", "m2", 5.0)], SCHEMA), path, buckets=16, match=["uuid", "model"])
    assert sorted((r["model"], r["recall"]) for r in kt.lookup(spark, path, SCHEMA, ["u7"], buckets=16).collect()) == [("m1", -1.0), ("m2", 5.0)]


def test_lookup_opens_the_buckets_of_its_keys(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    kt.write_table(_rows(spark, 5000, "1.0D"), path, buckets=64)
    keys = [f"u{i}" for i in range(0, 5000, 500)] + ["nobody", None, "u0"]
    found = kt.lookup(spark, path, SCHEMA, keys, buckets=64)
    assert sorted(r["uuid"] for r in found.collect()) == sorted({k for k in keys if k and k != "nobody"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "key_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "In(uuid" in plan
    files = found.select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 11 and len(_files(path)) == 64
    assert kt.lookup(spark, path, SCHEMA, []).count() == 0


def _pairs(spark, n):
    return spark.createDataFrame([(f"u{i}", "m", quotes("a"), quotes("a", str(i))) for i in range(n)],
                                 "uuid string, model string, ground_truth string, system_response string")


def test_calls_in_flight_of_one_task(spark, tmp_dir):
    """Calls of 50 ms: eight in flight take a fraction of the time, with equal answers."""
    def make_judge():
        def judge(gt, resp):
            time.sleep(0.05)
            return len(resp) % 7 / 7, 0.5
        return judge

    took, answers = {}, {}
    for k in (1, 8):
        start = time.time()
        out = callable_judge(_pairs(spark, 80), make_judge, f"{tmp_dir}/a{k}", parallelism=1, chunks=1, in_flight=k)
        answers[k] = sorted(out.select("uuid", "recall", "precision", "judged").collect())
        took[k] = time.time() - start
    assert answers[1] == answers[8] and all(r["judged"] for r in answers[8])
    assert took[1] - took[8] > 2.0  # 80 calls one by one take 4 s


def test_failed_calls_are_made_again_and_paced(spark, tmp_dir):
    marks = f"{tmp_dir}/marks"
    os.makedirs(marks)

    def make_judge():
        def judge(gt, resp):
            mark = f"{marks}/{abs(hash(resp))}"
            if "never" in resp:
                raise RuntimeError("down")
            if not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("first call fails")
            return 1.0, 1.0
        return judge

    samples = _pairs(spark, 6).unionByName(_pairs(spark, 1).withColumns({"uuid": F.lit("x"), "system_response": F.lit("never")}))
    start = time.time()
    out = callable_judge(samples, make_judge, f"{tmp_dir}/a", parallelism=1, chunks=1, in_flight=4, retries=1, backoff=0.01, calls_per_second=20)
    got = {r["uuid"]: r["judged"] for r in out.collect()}
    assert got == {**{f"u{i}": True for i in range(6)}, "x": False} and time.time() - start > 13 / 20
    assert saved_judgments(spark, f"{tmp_dir}/a", 0).count() == 7


def test_outcomes_counted_while_written(spark):
    testset = spark.createDataFrame([("u0", quotes("a")), ("u1", quotes("b"))], "uuid string, quotes string")
    inf = spark.createDataFrame([(u, m, quotes("a")) for u in ("u0", "u1") for m in ("m", "n")], "uuid string, model string, quotes string")
    judged = spark.createDataFrame([("u0", "m", 1.0, 1.0), ("u1", "m", None, 1.0)], "uuid string, model string, recall double, precision double")
    prior = spark.createDataFrame([("u0", "n", 1.0, 1.0, 1.0, 1.0, 1.0)], "uuid string, model string, " + ", ".join(f"{c} double" for c in sc.SCORE_COLUMNS))
    ev = jobs.evaluate(spark, testset, inf, judgments=judged, prior_scores=prior)
    counts = {o: 0 for o in rp.OUTCOMES}
    for r in ev.outcomes.collect():
        counts[r["status"]] += r["n"]
    assert ev.counts == counts == {"scored": 1, "judge_error": 1, "crash": 1, "skipped": 1}


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_dir):
    """No task holds a whole bucket: one bucket here, of many times the advisory partition size."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        rows = spark.range(0, 40_000, 1, 8).selectExpr("concat('u', id) AS uuid", "'m' AS model", "rand(1) AS recall")
        kt.write_table(rows, f"{tmp_dir}/t", buckets=1)
    finally:
        spark.conf.set(key, old)
    assert len(_files(f"{tmp_dir}/t")) > 1 and kt.read_table(spark, f"{tmp_dir}/t", SCHEMA).select("uuid").distinct().count() == 40_000


def test_upsert_moves_and_writes_rows_once(spark, tmp_dir, monkeypatch):
    """One exchange and one write for all rows of the touched buckets, dealt to several tasks by their size; nothing is left beside the table."""
    path, writes = f"{tmp_dir}/t", []
    rows = spark.range(0, 20_000, 1, 4).selectExpr("concat('u', id) AS uuid", "'m' AS model", "rand(1) AS recall")
    kt.write_table(rows, path, buckets=1)
    save = kt._save
    monkeypatch.setattr(kt, "_save", lambda laid, *a: (writes.append(laid._jdf.queryExecution().executedPlan().toString()), save(laid, *a)))
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    old = {key: spark.conf.get(key) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        new = spark.createDataFrame([("u7", "m", -1.0), ("fresh", "m", 2.0), ("u8", None, 3.0), (None, "m", 4.0)], SCHEMA)
        kt.upsert_table(new, path, buckets=1, match=["uuid", "model"])
        kt.upsert_table(new.where("recall > 2"), path, buckets=1, match=["uuid", "model"])
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert [p.count("Exchange") for p in writes] == [1, 1] and "SortMergeJoin" not in writes[0]
    assert len(_files(path)) > 1 and os.listdir(tmp_dir) == ["t"]
    found = kt.read_table(spark, path, SCHEMA)
    assert found.count() == 20_000 + 1 + 2 + 2  # a null matches nothing, so these are added again
    assert [r["recall"] for r in found.where("uuid IN ('u7', 'fresh')").orderBy("recall").collect()] == [-1.0, 2.0]
