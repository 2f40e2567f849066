"""Registered check queries: one Spark callable and (where SQL can express it) one
DuckDB SQL text per operator of the inventory. Each callable reads the driver's
tables through the fixtures and runs the library's operators on the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.functions.metrics import f1, repair_precision, round_half_up
from evidence_spark.functions.text import format_score, parse_quotes, question_key, tokenize
from evidence_spark.operators import bm25 as bm, token_join
from evidence_spark.operators import report as rp
from evidence_spark.operators import scoring as sc
from evidence_spark.operators.judge import judge_from_table, lexical_judge
from evidence_spark.plans import oracle as O
from evidence_spark.plans.fixtures import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _fx(spark, sf, name):
    return fixture(spark, sf, name)


def _scoring(spark, sf):
    return _fx(spark, sf, "fx_testset"), _fx(spark, sf, "fx_inf"), _fx(spark, sf, "fx_judgments")


def _samples(spark, sf, **kw):
    ts, inf, j = _scoring(spark, sf)
    return sc.evaluation_samples(ts, inf, **kw), j


def _results(spark, sf, judge="table"):
    ts, inf, j = _scoring(spark, sf)
    samples = sc.evaluation_samples(ts, inf, judgments=j if judge == "table" else None, parsed=True)
    return sc.score_samples(samples, judge=judge)


# --------------------------------------------------------------------------- text
@register(
    "t01_parse_quotes",
    O.q(["fx_inf"], f"SELECT uuid, model, CAST(generate_subscripts(qs, 1) - 1 AS BIGINT) AS idx, "
                    f"unnest(qs) AS quote FROM (SELECT uuid, model, {O.parse('quotes')} AS qs FROM fx_inf)"),
)
def t01_parse_quotes(spark, sf):
    inf = _fx(spark, sf, "fx_inf")
    out = inf.select("uuid", "model", F.posexplode(parse_quotes("quotes")).alias("idx", "quote"))
    return out.withColumn("idx", F.col("idx").cast("bigint"))


@register(
    "t02_format_score",
    O.q(["fx_inf"], f"SELECT uuid, model, CAST({O.fmt('quotes')} AS DOUBLE) AS format_score FROM fx_inf"),
)
def t02_format_score(spark, sf):
    inf = _fx(spark, sf, "fx_inf")
    return inf.select("uuid", "model", format_score("quotes").alias("format_score"))


_GOLD_ALL = ("gold", "SELECT uuid, quotes AS gt FROM fx_testset")


@register(
    "t03_tokens",
    O.q(["fx_testset"], "SELECT uuid, CAST(gidx AS BIGINT) AS gidx, token, CAST(tf AS BIGINT) AS tf FROM gtf",
        [_GOLD_ALL] + O.bm25_ctes("gold", "fx_inf")[:3]),
)
def t03_tokens(spark, sf):
    ts = _fx(spark, sf, "fx_testset")
    g = ts.select("uuid", F.posexplode(parse_quotes("quotes")).alias("gidx", "q"))
    t = g.select("uuid", F.col("gidx").cast("bigint").alias("gidx"), F.explode(tokenize("q")).alias("token"))
    return t.groupBy("uuid", "gidx", "token").agg(F.count(F.lit(1)).alias("tf"))


@register(
    "t04_question_key",
    O.q(["fx_docs"], f"SELECT hf_id, lower({O.strip('question')}) AS qkey FROM fx_docs"),
)
def t04_question_key(spark, sf):
    return _fx(spark, sf, "fx_docs").select("hf_id", question_key("question").alias("qkey"))


@register(
    "t05_bm25_term_stats",
    O.q(["fx_testset", "fx_inf"],
        f"SELECT i.uuid, CAST(n.n_quotes AS BIGINT) AS n_quotes, {O.r4('n.avgdl', 6)} AS avgdl, i.token, "
        f"CAST(i.df AS BIGINT) AS df, {O.r4('i.idf', 6)} AS idf FROM gidf i JOIN gn n USING (uuid)",
        [_GOLD_ALL] + O.bm25_ctes("gold", "fx_inf")[:9]),
)
def t05_bm25_term_stats(spark, sf):
    ts = _fx(spark, sf, "fx_testset").withColumn("gold_quotes", parse_quotes("quotes"))
    st = bm.term_statistics(ts, "uuid", "gold_quotes")
    return st.select(
        "uuid", "n_quotes", round_half_up("avgdl", 6).alias("avgdl"), "token", "df",
        round_half_up("idf", 6).alias("idf"),
    )


@register(
    "t06_bm25_best_match",
    O.q(O.SCORING_FX, f"SELECT uuid, model, CAST(ridx AS BIGINT) AS ridx, {O.r4('best', 6)} AS best FROM rbest",
        [O.SAMPLES, O.GOLD] + O.bm25_ctes("gold", "samples")),
)
def t06_bm25_best_match(spark, sf):
    samples, _ = _samples(spark, sf)
    s = samples.where(F.size("gold_quotes") > 0).withColumn("resp_quotes", parse_quotes("system_response"))
    out = bm.best_matches(s, ["uuid", "model"], "gold_quotes", "resp_quotes")
    return out.select("uuid", "model", "ridx", round_half_up("best", 6).alias("best"))


_PAIRS_ALL = ("pairs", "SELECT uuid, model, quotes AS resp FROM fx_inf")


@register(
    "t07_bm25",
    O.q(["fx_testset", "fx_inf"], "SELECT uuid, model, CAST(bm25 AS DOUBLE) AS bm25 FROM bm",
        [_GOLD_ALL, _PAIRS_ALL] + O.bm25_ctes("gold", "pairs")),
)
def t07_bm25(spark, sf):
    ts = _fx(spark, sf, "fx_testset").select("uuid", F.col("quotes").alias("gt"))
    gold = ts.withColumn("gold_quotes", parse_quotes("gt"))
    inf = _fx(spark, sf, "fx_inf").select("uuid", "model", F.col("quotes").alias("resp"))
    pairs = inf.join(gold, "uuid", "left").withColumn(
        "gold_quotes", F.coalesce("gold_quotes", F.array().cast("array<string>"))
    ).withColumn("resp_quotes", parse_quotes("resp"))
    return bm.add_bm25(pairs, "gold_quotes", "resp_quotes").select("uuid", "model", "bm25")


@register("t07b_bm25_join", ORACLE["t07_bm25"])
def t07b_bm25_join(spark, sf):
    """The BM25 score by token joins; documents without golden text are left out of the golden side."""
    ts = _fx(spark, sf, "fx_testset").select("uuid", parse_quotes("quotes").alias("gold_quotes"))
    pairs = _fx(spark, sf, "fx_inf").select("uuid", "model", parse_quotes("quotes").alias("resp_quotes"))
    return token_join.bm25_join(pairs, ts)


# --------------------------------------------------------------------------- metrics
@register(
    "t08_f1",
    O.q(["fx_all_judgments"], f"SELECT uuid, model, CAST({O.f1('precision', 'recall')} AS DOUBLE) AS f1 FROM fx_all_judgments"),
)
def t08_f1(spark, sf):
    j = _fx(spark, sf, "fx_all_judgments")
    return j.select("uuid", "model", f1("precision", "recall").alias("f1"))


@register(
    "t09_repair_precision",
    O.q(O.SCORING_FX, "SELECT uuid, model, recall, CAST(p2 AS DOUBLE) AS precision FROM repaired WHERE ok",
        O.scored_ctes()),
)
def t09_repair_precision(spark, sf):
    samples, j = _samples(spark, sf, parsed=True)
    # quotes are counted before the join: no text is moved
    s = samples.select("uuid", "model", "n_gold", "n_resp").join(j.select("uuid", "model", "recall", "precision"), ["uuid", "model"])
    p = repair_precision("recall", "precision", F.col("n_gold"), F.col("n_resp"))
    return s.select("uuid", "model", "recall", p.alias("precision"))


@register(
    "t10a_judge_table",
    O.q(O.SCORING_FX, "SELECT uuid, model, recall, precision, CAST(ok AS BIGINT) AS judged FROM judged",
        O.scored_ctes()),
)
def t10a_judge_table(spark, sf):
    samples, j = _samples(spark, sf)
    out = judge_from_table(samples.select("uuid", "model"), j)
    return out.select("uuid", "model", "recall", "precision", F.col("judged").cast("bigint").alias("judged"))


@register(
    "t10b_judge_lexical",
    O.q(O.SCORING_FX, "SELECT uuid, model, CAST(recall AS DOUBLE) AS recall, CAST(precision AS DOUBLE) AS precision FROM lex",
        [O.SAMPLES, O.GOLD] + O.bm25_ctes("gold", "samples") + O.lexical_ctes()),
)
def t10b_judge_lexical(spark, sf):
    samples, _ = _samples(spark, sf)
    s = samples.withColumn("resp_quotes", parse_quotes("system_response"))
    return lexical_judge(s, "gold_quotes", "resp_quotes").select("uuid", "model", "recall", "precision")


@register("t10c_judge_lexical_join", ORACLE["t10b_judge_lexical"])
def t10c_judge_lexical_join(spark, sf):
    """The lexical judge by token joins with prefix and size filters."""
    samples, _ = _samples(spark, sf)
    s = samples.select("uuid", "model", parse_quotes("system_response").alias("resp_quotes"))
    gold = _fx(spark, sf, "fx_testset").select("uuid", parse_quotes("quotes").alias("gold_quotes"))
    return token_join.lexical_judge_join(s, gold).select("uuid", "model", "recall", "precision")


_RES_COLS = (
    "SELECT uuid, model, status, CAST(recall AS DOUBLE) AS recall, CAST(precision AS DOUBLE) AS precision, "
    "CAST(f1 AS DOUBLE) AS f1, CAST(bm25 AS DOUBLE) AS bm25, CAST(format_score AS DOUBLE) AS format_score FROM res"
)


@register("t11_score_pairs", O.q(O.SCORING_FX, _RES_COLS, O.scored_ctes()))
def t11_score_pairs(spark, sf):
    return _results(spark, sf)


@register("t11b_score_pairs_lexical", O.q(O.SCORING_FX, _RES_COLS, O.scored_ctes("lexical")))
def t11b_score_pairs_lexical(spark, sf):
    return _results(spark, sf, judge="lexical")


# --------------------------------------------------------------------------- reports
_STORED = ("stored", "SELECT * FROM res WHERE status = 'scored'")


@register("a01_model_report", O.q(O.SCORING_FX, O.report_select("stored"), O.scored_ctes() + [_STORED]))
def a01_model_report(spark, sf):
    return rp.model_report(sc.stored_scores(_results(spark, sf)))


@register(
    "a02_model_report_one",
    O.q(O.SCORING_FX, O.report_select("stored", "WHERE model = 'm_first'"), O.scored_ctes() + [_STORED]),
)
def a02_model_report_one(spark, sf):
    return rp.model_report(sc.stored_scores(_results(spark, sf)), model="m_first")


@register(
    "a03_run_summary",
    O.q(O.SCORING_FX,
        "SELECT model, "
        + ", ".join(f"coalesce({O.r4(f'avg(CASE WHEN f1 IS NOT NULL THEN {m} END)')}, 0.0) AS avg_{m}"
                    for m in ("recall", "precision", "f1"))
        + ", count(f1) AS count FROM res GROUP BY model",
        O.scored_ctes()),
)
def a03_run_summary(spark, sf):
    return rp.run_summary(_results(spark, sf))


@register(
    "a04_bm25_summary",
    O.q(O.SCORING_FX,
        f"SELECT model, coalesce({O.r4('avg(CASE WHEN bm25 <> 0 THEN bm25 END)')}, 0.0) AS avg_bm25, "
        "count(CASE WHEN bm25 <> 0 THEN bm25 END) AS count FROM res GROUP BY model",
        O.scored_ctes()),
)
def a04_bm25_summary(spark, sf):
    return rp.bm25_summary(_results(spark, sf))


@register(
    "a05_format_summary",
    O.q(O.SCORING_FX,
        f"SELECT model, coalesce({O.r4('avg(format_score)')}, 0.0) AS avg_format_score, "
        "count(format_score) AS count FROM res GROUP BY model",
        O.scored_ctes()),
)
def a05_format_summary(spark, sf):
    return rp.format_summary(_results(spark, sf))


_NESTED = ("nst", "SELECT model, CASE WHEN recall IS NOT NULL AND recall < 1 THEN f1 END AS f1, recall, precision FROM res")


@register(
    "a03b_run_summary_nested",
    O.q(O.SCORING_FX,
        "SELECT model, "
        + ", ".join(f"coalesce({O.r4(f'avg(CASE WHEN f1 IS NOT NULL THEN {m} END)')}, 0.0) AS avg_{m}"
                    for m in ("recall", "precision", "f1"))
        + ", count(f1) AS count FROM nst GROUP BY model",
        O.scored_ctes() + [_NESTED]),
)
def a03b_run_summary_nested(spark, sf):
    """A3 with the metrics under a key that some rows lack."""
    r = _results(spark, sf)
    m = F.when(F.col("recall") < 1, F.struct("recall", "precision", "f1"))
    return rp.run_summary(r.select("model", m.alias("scores")), key="scores")


@register(
    "a04b_bm25_fallback",
    O.q(O.SCORING_FX,
        f"SELECT model, coalesce({O.r4('avg(coalesce(nullif(bm25, 0), format_score))')}, 0.0) AS avg_bm25, "
        "count(coalesce(nullif(bm25, 0), format_score)) AS count FROM res GROUP BY model",
        O.scored_ctes()),
)
def a04b_bm25_fallback(spark, sf):
    """A4 with another column where BM25 is missing or 0."""
    return rp.bm25_summary(_results(spark, sf), fallback="format_score")


_CANDS = (
    "cands",
    "SELECT * FROM fx_testset t WHERE (t.quotes IS NULL OR t.quotes <> '') "
    "AND EXISTS (SELECT 1 FROM fx_inf i WHERE i.uuid = t.uuid)",
)


@register(
    "a06_models",
    O.q(["fx_testset", "fx_inf"], "SELECT DISTINCT model FROM fx_inf WHERE uuid IN (SELECT uuid FROM cands)", [_CANDS]),
)
def a06_models(spark, sf):
    ts, inf, _ = _scoring(spark, sf)
    return sc.available_models(sc.candidate_documents(ts, inf), inf)


@register("a07_candidate_count", O.q(["fx_testset", "fx_inf"], "SELECT count(*) AS count FROM cands", [_CANDS]))
def a07_candidate_count(spark, sf):
    ts, inf, _ = _scoring(spark, sf)
    return rp.candidate_count(sc.candidate_documents(ts, inf))


@register(
    "a11_outcomes",
    O.q(O.SCORING_FX, "SELECT model, status, count(*) AS n FROM res GROUP BY ALL", O.scored_ctes()),
)
def a11_outcomes(spark, sf):
    return rp.outcome_counts(_results(spark, sf))


@register(
    "l01_report_sorted",
    O.q(O.SCORING_FX, "SELECT row_number() OVER (ORDER BY model) AS place, model FROM (SELECT DISTINCT model FROM stored)",
        O.scored_ctes() + [_STORED]),
)
def l01_report_sorted(spark, sf):
    """L1: the place of each model in the report's own order (one row per model)."""
    rows = [(i + 1, r["model"]) for i, r in enumerate(rp.model_report(sc.stored_scores(_results(spark, sf))).collect())]
    return spark.createDataFrame(rows, "place bigint, model string")


# part 2 registers itself on import (curation, chat, sources, jobs)
from evidence_spark.plans import queries_more  # noqa: E402,F401
