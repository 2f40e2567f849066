import math

import pytest
from pyspark.sql import functions as F

from evidence_spark.functions import (
    f1,
    format_score,
    normalize_text,
    parse_quotes,
    question_key,
    repair_precision,
    tokenize,
)
from evidence_spark.operators import report as rp

B, E = "##begin_quote##", "##end_quote##"
BOM = "﻿"

PARSE_FORMAT = [
    (None, [], 0.0),
    ("", [], 0.0),
    ("   \n ", [], 0.0),
    (BOM, [], 0.0),
    (f"{B} a {E}\n{B} b {E}", ["a", "b"], 1.0),
    (f"x{B} a {E}", ["a"], 0.0),
    (f"{B}{E}", [], 1.0),
    (f"{B} a", [], 0.0),
    (f"{B}a {B} b{E}", [f"a {B} b"], 1.0),
    (f"{BOM} {B}a{E}", ["a"], 1.0),
    (f"{BOM} {BOM}{B}a{E}", ["a"], 0.0),
    (f"{B}a{E}\x1c", ["a"], 1.0),
    (f"{B} a\nb {E}", ["a\nb"], 1.0),
    (f"{B}　a {E}", ["a"], 1.0),
]


def test_parse_and_format(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(PARSE_FORMAT)], "i int, t string")
    rows = {r["i"]: r for r in df.select("i", parse_quotes("t").alias("q"), format_score("t").alias("f")).collect()}
    for i, (_, quotes, fmt) in enumerate(PARSE_FORMAT):
        assert rows[i]["q"] == quotes, PARSE_FORMAT[i]
        assert rows[i]["f"] == fmt, PARSE_FORMAT[i]


def test_markers_that_overlap(spark):
    """Markers that share number signs are read as the pattern reads them."""
    import re

    ws = "[ \\s\x1c-\x1f]*"
    pattern = re.compile(f"{B}{ws}(.*?){ws}{E}", re.S)
    texts = [f"{B}{E[2:]} {B} x {E}", f"{B}{E[1:]} {B} x {E}", f"{E}{B[2:]} x {E}", f"{E}{B[1:]} x {E}", f"{B} x {E}{E[2:]}", f"{B} x {E}{E[1:]}",
             f"{B}{B[2:]} x {E}", f"{E}{B}x{E}", f"{B}x{E}{B}", f"{B} x{E}{B} {E} \n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", parse_quotes("t").alias("q"), format_score("t").alias("f")).collect():
        t = texts[r["i"]]
        assert r["q"] == [q for q in pattern.findall(t) if q], t
        assert r["f"] == float(bool(pattern.search(t)) and not pattern.sub("", t).strip()), t


def test_blocks_never_closed_are_linear(spark):
    """Begin markers without an end are not each tried to the end of the text (before: minutes)."""
    import time

    t = time.monotonic()
    text = F.concat(F.lit(f"{B} a {E}"), F.repeat(F.lit(f"{B} some words of a line\n"), 40_000))
    row = spark.range(1).select(F.size(parse_quotes(text)).alias("n"), format_score(text).alias("f")).first()
    assert (row["n"], row["f"]) == (1, 0.0)
    assert time.monotonic() - t < 30


def test_tokenize_and_key(spark):
    df = spark.createDataFrame([("  Alpha\tBETA  gamma\x1fdelta ",), ("",), ("   ",)], "t string")
    got = [r[0] for r in df.select(tokenize("t")).collect()]
    assert got == [["alpha", "beta", "gamma", "delta"], [], []]
    assert df.select(question_key("t")).first()[0] == "alpha\tbeta  gamma\x1fdelta"


F1_CASES = [((0.0, 0.0), 0.0), ((1.0, 4.0), 1.0), ((1.0, -1.0), 0.0), ((1.0, 0.5), 0.6667), ((None, 0.5), None)]


def test_f1(spark):
    df = spark.createDataFrame([(p, r) for (p, r), _ in F1_CASES], "p double, r double")
    got = [r[0] for r in df.select(f1("p", "r")).collect()]
    for (args, want), value in zip(F1_CASES, got):
        if want is None:
            assert value is None
        else:
            assert value == pytest.approx(want, abs=1e-4), args


REPAIR = [((1, 0, 4, 1), 4.0), ((0.5, 0, 2, 4), 0.25), ((0.1, 0, 1, 2), 0.5), ((0, 0.5, 1, 1), 0.5),
          ((0.5, 0, 2, 0), 0.0), ((0.5, None, 2, 2), 0.5)]


def test_repair(spark):
    df = spark.createDataFrame([tuple(float(x) if x is not None else None for x in a[:2]) + a[2:] for a, _ in REPAIR],
                               "r double, p double, ng int, nr int")
    got = [r[0] for r in df.select(repair_precision("r", "p", "ng", "nr")).collect()]
    assert got == [w for _, w in REPAIR]


def test_report_clamp_and_summaries(spark):
    vals = [None, -2.53, float("nan"), 0.5, 4.0]
    df = spark.createDataFrame([("u%d" % i, "m", v, v, v, v, v) for i, v in enumerate(vals)],
                               "uuid string, model string, recall double, precision double, f1 double, bm25 double, format_score double")
    row = rp.model_report(df).first()
    assert row["avg_recall"] == 0.9 and row["avg_bm25"] == 0.9 and row["count"] == 5
    b = spark.createDataFrame([("m", v) for v in (0.0, 0.5, None, 1.0)], "model string, bm25 double")
    s = rp.bm25_summary(b).first()
    assert (s["avg_bm25"], s["count"]) == (0.75, 2)
    stored = b.select("model", *[F.col("bm25").alias(c) for c in ("recall", "precision", "f1", "bm25", "format_score")])
    r = rp.model_report(stored).first()
    assert (r["avg_bm25"], r["count"]) == (0.375, 4)


def test_run_summary_defaults(spark):
    df = spark.createDataFrame([("m", None, None, None)], "model string, recall double, precision double, f1 double")
    r = rp.run_summary(df).first()
    assert (r["avg_recall"], r["avg_precision"], r["avg_f1"], r["count"]) == (0.0, 0.0, 0.0, 0)


NORMALISE = [
    (None, None),
    ('"s"', "s"),
    ('[{"text":"a"},{"text":"b"}]', "ab"),
    ('[{"x":1}]', ""),
    ('[{"text":"a"},"z"]', "a"),
    ('["z"]', '["z"]'),
    ("5", "5"),
    ("null", None),
]


def test_normalize_text(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NORMALISE)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", normalize_text("t").alias("n")).collect()}
    assert [got[i] for i in range(len(NORMALISE))] == [w for _, w in NORMALISE]


def test_round_half_up_removes_negative_zero(spark):
    from evidence_spark.functions import round_half_up

    v = spark.range(1).select(round_half_up(F.lit(-0.0)).alias("x")).first()["x"]
    assert v == 0.0 and math.copysign(1.0, v) == 1.0
