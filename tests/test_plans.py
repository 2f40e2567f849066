"""Plan shape: no row-at-a-time Python, each table moved once, skewed joins split, anti
joins where promised, no all-pairs joins, pruning reaches the scan."""

from conftest import SF_SMALL

from evidence_spark.operators import curate as cu
from evidence_spark.operators import report as rp
from evidence_spark.operators import scoring as sc
from evidence_spark.plans import jobs
from evidence_spark.plans.fixtures import fixture
from evidence_spark.plans.queries import QUERIES
from evidence_spark.session import scratch_path


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_rows_and_no_all_pairs(spark):
    for name in ["t01_parse_quotes", "t02_format_score", "t08_f1", "t05_bm25_term_stats", "p04_conversation"]:
        p = _plan(QUERIES[name](spark, SF_SMALL))
        assert "Python" not in p, name
    for name in ["t07_bm25", "t09_repair_precision", "t10b_judge_lexical", "t11_score_pairs", "a01_model_report"]:
        p = _plan(QUERIES[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_scoring_moves_each_table_once(spark, tmp_dir):
    """Default session settings, no broadcast: nothing is shuffled above the scores, and the
    inferences are scanned and shuffled once."""
    tables = {}
    for name in ("fx_testset", "fx_inf", "fx_judgments", "fx_prior_scores"):
        fixture(spark, SF_SMALL, name).write.parquet(f"{tmp_dir}/{name}")
        tables[name] = spark.read.parquet(f"{tmp_dir}/{name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        samples = sc.evaluation_samples(tables["fx_testset"], tables["fx_inf"], tables["fx_prior_scores"],
                                        judgments=tables["fx_judgments"])
        p = _plan(sc.score_samples(samples))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.index("ArrowEvalPython") < p.index("Exchange")
    assert p.count(f"{tmp_dir}/fx_inf") == 1
    assert p.count("Exchange hashpartitioning(uuid") == 6  # four tables, two of them first gathered by (uuid, model)


def test_a_summary_without_texts_moves_none(spark, tmp_dir):
    """Quotes are counted and formats checked before the join: no text or quote array is joined or shuffled."""
    tables = {}
    for name in ("fx_testset", "fx_inf", "fx_judgments"):
        fixture(spark, SF_SMALL, name).write.parquet(f"{tmp_dir}/{name}")
        tables[name] = spark.read.parquet(f"{tmp_dir}/{name}")
    samples = sc.evaluation_samples(tables["fx_testset"], tables["fx_inf"], judgments=tables["fx_judgments"], parsed=True)
    summary = rp.format_summary(sc.score_samples(samples))
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Join Inner")]
    assert "format_score" in above and not [c for c in ("system_response", "ground_truth", "gold_quotes#", "resp_quotes#") if c in above]
    plain = sc.evaluation_samples(tables["fx_testset"], tables["fx_inf"], judgments=tables["fx_judgments"])
    assert sorted(map(str, sc.score_samples(samples).collect())) == sorted(map(str, sc.score_samples(plain).collect()))


def test_repaired_precision_moves_numbers_only(spark):
    """Quotes are counted where the texts are read: neither they nor the texts stand above the join of pairs and judgments."""
    plan = QUERIES["t09_repair_precision"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("n_gold")]
    assert "n_resp" in plan and not [c for c in ("system_response", "ground_truth", "gold_quotes", "resp_quotes") if c in above]


def test_novelty_splits_a_hot_question(spark, tmp_dir):
    spark.range(40_000).selectExpr("if(id % 2 = 0, 'hot', concat('q', id)) AS question", "repeat('c', 200) AS context",
                                   "'train' AS split").repartition(8).write.parquet(f"{tmp_dir}/corpus")
    spark.range(20_000).selectExpr("concat('q', id * 3) AS question", "repeat('z', 50) AS filler").repartition(4).write.parquet(f"{tmp_dir}/old")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = cu.novel_samples(spark.read.parquet(f"{tmp_dir}/corpus"), cu.question_keys(spark.read.parquet(f"{tmp_dir}/old")), "train")
        n = out.count()
        rows = out.select("question", "context")
        rows.collect()
        assert "skew=true" in _plan(rows)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert n > 20_000


def test_anti_joins(spark):
    assert "LeftAnti" in _plan(QUERIES["j01_novelty"](spark, SF_SMALL))


def test_split_filter_prunes_partitions(spark):
    path = scratch_path(spark, "corpus-plan")
    jobs.write_corpus(fixture(spark, SF_SMALL, "fx_docs").drop("doc_id"), path)
    p = _plan(jobs.read_corpus(spark, path, "validation").select("hf_id"))
    assert "PartitionFilters: [isnotnull(split_key" in p and "validation" in p
    assert "ReadSchema: struct<hf_id:string,split:string>" in p
