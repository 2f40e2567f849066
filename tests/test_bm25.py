import math

import pytest

from evidence_spark.functions import parse_quotes
from evidence_spark.operators import bm25 as bm

from conftest import quotes

# Golden values (gold quotes, response quotes, expected) written from the formula.
CASES = [
    ("B1", ["the cat sat"], ["the cat sat"], 1.0),
    ("B2", ["the cat sat"], ["dog ran"], 0.0),
    ("B3", ["the cat sat"], ["the cat ran"], 0.6667),
    ("B4", ["a b", "c d"], ["a b", "c d"], 0.0),
    ("B5", ["a b", "c d", "e f"], ["a b", "c d", "e f"], 1.0),
    ("B6", ["a b", "c d", "e f"], ["a b", "c d"], 0.6667),
    ("B7", ["a b", "c d", "e f"], ["a b", "a b", "a b"], 1.0),
    ("B8", ["the a", "the b"], ["the a", "the b"], 1.0),
    ("B9", ["the cat sat", "the dog ran fast", "a bird"], ["the cat ran", "bird song"], 0.3233),
    ("B10", ["a b", "c d", "e f"], ["a a a"], 0.5),
    ("B11", ["Alpha beta", "gamma", "delta"], ["ALPHA BETA"], 0.4201),
    ("B12", ["x x y", "x y", "x z"], ["x", "z"], -2.53),
    ("B13", ["x y", "x z", "x y"], ["z"], 1.0),
    ("B14", ["x y", "x y", "x z"], ["x y", "x z"], 1.0),
    ("B15", ["a b", "c d", "e f"], ["a b", "zzz"], 0.3333),
]


def _score(spark, rows):
    df = spark.createDataFrame(rows, "id string, gold string, resp string")
    df = df.withColumn("g", parse_quotes("gold")).withColumn("r", parse_quotes("resp"))
    out = bm.add_bm25(df, "g", "r").select("id", "bm25")
    return {r["id"]: r["bm25"] for r in out.collect()}


def test_golden_cases(spark):
    rows = [(cid, quotes(*g), quotes(*r)) for cid, g, r, _ in CASES]
    got = _score(spark, rows)
    for cid, _, _, want in CASES:
        assert got[cid] == pytest.approx(want, abs=1e-4), cid
        assert math.copysign(1.0, got[cid]) == math.copysign(1.0, want) or want == 0


def test_empty_sides_score_zero(spark):
    got = _score(
        spark,
        [("a", "", quotes("x")), ("b", quotes("x"), ""), ("c", None, None), ("d", quotes("x"), "[x]")],
    )
    assert got == {"a": 0.0, "b": 0.0, "c": 0.0, "d": 0.0}


def test_no_negative_zero(spark):
    got = _score(spark, [("B2", quotes("the cat sat"), quotes("dog ran"))])
    assert math.copysign(1.0, got["B2"]) == 1.0


def test_quote_order_does_not_change_score(spark):
    g = ["the cat sat", "the dog ran fast", "a bird"]
    r = ["the cat ran", "bird song"]
    got = _score(spark, [("a", quotes(*g), quotes(*r)), ("b", quotes(*reversed(g)), quotes(*reversed(r)))])
    assert got["a"] == pytest.approx(got["b"], abs=1e-9)


def test_single_gold_sums_are_negative():
    index = bm.GoldIndex([["the", "cat", "sat"]])
    assert index.best(index.quotes)[0] == pytest.approx(-0.823959, abs=1e-6)


def test_blocks_do_not_change_scores(monkeypatch):
    gold = [f"w{i % 7} w{i % 3} x{i}".split() for i in range(40)]
    whole = bm.GoldIndex(gold).best(gold)
    monkeypatch.setattr(bm, "BLOCK_CELLS", 1)
    assert (bm.GoldIndex(gold).best(gold) == whole).all()


def _random_rows(seed):
    import random

    rnd = random.Random(seed)
    side = lambda: [" ".join(rnd.choice("aA bB c d e f g h".split()) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(0, 5))]
    golds = [side() for _ in range(40)]
    gold = [g for g in golds for _ in range(rnd.randint(1, 4))]
    return gold, [side() for _ in gold]


@pytest.mark.parametrize("tokens", [1, 30, 1 << 16])
def test_rows_scored_in_groups_equal_rows_scored_alone(monkeypatch, tokens):
    import pyarrow as pa

    from evidence_spark.operators import judge

    monkeypatch.setattr(bm, "BLOCK_TOKENS", tokens)
    gold, response = _random_rows(tokens)
    kind = pa.list_(pa.string())
    got = bm._match.func(pa.array([*gold, None], kind), pa.array([*response, None], kind)).to_pylist()
    lexical = []
    for golds, rows, responses in bm.quote_blocks(gold, response):
        lexical += judge._overlaps(golds, rows, responses, 0.5)
    assert got.pop() == {"best": [], "perfect": 0.0}
    split = lambda side: [q.lower().split() for q in side]
    for g, r, m, overlap in zip(gold, response, got, lexical, strict=True):
        index = bm.GoldIndex(split(g))
        assert m["best"] == (index.best(split(r)).tolist() if g else [])
        assert m["perfect"] == (sum(index.best(index.quotes).tolist()) if g else 0.0)
        assert overlap == judge._overlap([set(q) for q in split(g)], [set(q) for q in split(r)], 0.5)


def test_golden_quotes_of_adjacent_rows_are_given_once():
    groups = list(bm.quote_blocks([["a b"], ["a b"], ["c"], ["a b"]], [["a"], [], ["c"], ["b"]]))
    assert [(len(g), rows) for g, rows, _ in groups] == [(3, [0, 0, 1, 2])]


def test_work_is_linear_in_the_text_of_a_row():
    """Twice the tokens in one row take about twice the time (quadratic: four times)."""
    import time

    def seconds(tokens):
        gold = [[f"t{q}_{i}" if i % 2 else f"c{i % 50}" for i in range(tokens // 4)] for q in range(4)]
        best = min(_timed(lambda: bm.GoldIndex(gold).best(gold)) for _ in range(3))
        return best

    def _timed(f):
        t = time.process_time()
        f()
        return time.process_time() - t

    assert seconds(160_000) < 3.2 * seconds(80_000)


def test_term_statistics(spark):
    df = spark.createDataFrame([("u", quotes("a b", "c d"))], "uuid string, gold string")
    stats = bm.term_statistics(df.withColumn("g", parse_quotes("gold")), "uuid", "g").collect()
    assert {r["token"] for r in stats} == {"a", "b", "c", "d"}
    assert all(r["df"] == 1 and r["idf"] == 0.0 and r["n_quotes"] == 2 for r in stats)


def test_no_row_at_a_time_python_and_no_shuffle(spark):
    df = spark.createDataFrame([("a", quotes("x y"), quotes("x"))], "id string, gold string, resp string")
    df = df.withColumn("g", parse_quotes("gold")).withColumn("r", parse_quotes("resp"))
    plan = bm.add_bm25(df, "g", "r")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "Exchange" not in plan


def test_token_joins_move_texts_not_tokens(spark):
    """Every exchange of quotes carries whole quotes; tokens meet within the parts (before: up to nine exchanges of tokens)."""
    from evidence_spark.operators import token_join

    rows = [(f"u{k}", "m", ["a b c", "b d"], ["a b", "d e"]) for k in range(20)]
    df = spark.createDataFrame(rows, "uuid string, model string, gold_quotes array<string>, resp_quotes array<string>")
    gold, samples = df.select("uuid", "gold_quotes"), df.select("uuid", "model", "resp_quotes")
    for out in (token_join.bm25_join(samples, gold), token_join.lexical_judge_join(samples, gold)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "token" in x]
        assert out.count() == 20


def test_contained_quote_meets_at_any_place_of_the_larger_one(spark):
    """The rarest token of a short golden quote may be a frequent one of a long response quote."""
    from evidence_spark.operators import token_join

    gold = spark.createDataFrame([("u", ["a", "a b c d", "a b c e", "a f g h"])], "uuid string, gold_quotes array<string>")
    samples = spark.createDataFrame([("u", "m", ["a x1 x2 x3 x4 x5 x6", "zz"])], "uuid string, model string, resp_quotes array<string>")
    row = token_join.lexical_judge_join(samples, gold).first()
    assert (row["recall"], row["precision"]) == (0.25, 0.5)


def test_token_joins_count_repeated_quotes_and_sort_numbers(spark):
    """Quotes that repeat, in an answer or in several, give what the row-by-row forms give; no token is sorted as text."""
    import random

    from evidence_spark.operators import token_join
    from evidence_spark.operators.judge import lexical_judge

    rnd = random.Random(5)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(40)]
    some = lambda n: [rnd.choice(pool) for _ in range(rnd.randint(0, n))]
    golds = {f"u{k}": some(9) for k in range(12)}
    rows = [(u, m, g, g if m == "same" else some(9)) for u, g in golds.items() for m in ("same", "m1", "m2")]
    df = spark.createDataFrame(rows, "uuid string, model string, gold_quotes array<string>, resp_quotes array<string>")
    gold = spark.createDataFrame(list(golds.items()), "uuid string, gold_quotes array<string>")
    samples = df.select("uuid", "model", "resp_quotes")
    judged = token_join.lexical_judge_join(samples, gold)
    for out, plain, cols in ((token_join.bm25_join(samples, gold), bm.add_bm25(df, "gold_quotes", "resp_quotes"), ["bm25"]),
                             (judged, lexical_judge(df, "gold_quotes", "resp_quotes"), ["recall", "precision"])):
        assert sorted(map(tuple, out.select("uuid", "model", *cols).collect())) == sorted(map(tuple, plain.select("uuid", "model", *cols).collect()))
        assert "token#" not in out._jdf.queryExecution().executedPlan().toString()
