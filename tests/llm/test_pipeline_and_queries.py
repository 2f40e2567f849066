"""The pipeline against brute force, and the registered queries against SQL."""

import collections
import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from evidence_spark.llm import op3_mixing, op4_quality  # noqa: E402
from evidence_spark.llm.queries import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "mixing sources to target weights",
                                                      "SentencePiece encoding and decoding"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    from oracle_check import compare, duck_connection

    problems, _ = compare(spark, duck_connection(SF), name, QUERIES[name], ORACLE[name], SF)
    assert not problems


def groups(rows, width, percent):
    """Sets of rows joined by links (brute force over pairs that share a shingle)."""
    sets = {}
    for r in rows:
        w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in re.findall("[^\x20\x09-\x0d]+", r["text"] or "")]
        sets[r["doc_id"]] = frozenset([tuple(w)] if 0 < len(w) < width else zip(*(w[k:] for k in range(width)), strict=False)) if w else frozenset()
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, SF)
    good = {r["doc_id"] for r in op4_quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["predicted"] == 1}
    rows = kept.collect()
    assert kept.columns == corpus_pipeline.COLUMNS and {r["doc_id"] for r in rows} == good
    assert {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    once = corpus_pipeline.jaccard_join(spark, kept, SF)
    root = groups(rows, 5, 80)
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(set(root.values())) and once.columns == corpus_pipeline.COLUMNS
    mixed = corpus_pipeline.mixing(spark, once, SF)
    copies = op3_mixing.poisson_mix(once).groupBy("doc_id").count().collect()
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({r[0]: r[1] for r in copies})
    last = corpus_pipeline.sampled_pieces(spark, mixed, SF).collect()
    assert len(last) == mixed.count() and all(r["lossless"] for r in last)
    by_id = collections.defaultdict(set)
    for r in last:
        by_id[r["doc_id"]].add(tuple(r["pieces"]))
    assert all(len(p) == 1 for p in by_id.values())
    whole = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r["doc_id"] for r in whole) == collections.Counter(r["doc_id"] for r in last)


def test_stages_on_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", "src0", 0), (1, "", "en", "src0", 0), (2, "a b", None, "new", 3), (2, "c d", None, "new", 3)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= 0 and "pieces" in docs.columns
