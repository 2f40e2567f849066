"""Line frequency, hard negatives and interval search against brute force, with odd rows."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidence_spark.llm import op11_lines as lf
from evidence_spark.llm import op12_negatives as hn
from evidence_spark.llm import op13_search as se

DOCS = "doc_id long, text string, source string, kept string, row int"


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


# ------------------------------------------------------------------ 11 line frequency
def own(i):
    return " ".join(f"word{i}x{k}" for k in range(30))


def line_rows(limit):
    menu = "Home  News\tShop contact IMPRINT about us legal notice cookie settings"
    rows = [(i, f"{menu}\n{own(i)}\r\n{menu.upper()}", "a", "x", 0) for i in range(limit + 1)]
    rows += [(100 + i, f"{menu}\nshort {i}", "a", None, 0) for i in range(3)]          # depleted
    rows += [(200 + i, f"{menu}\nshort {i} text with words enough to stay whatever is cut", None, None, 0) for i in range(limit)]
    rows += [(300, None, None, None, None), (301, "", "a", "", 1), (302, " \n\t\n ", "b", "", 1), (303, "a b c d e " * 4000, "b", "", 1),
             (304, "# one & two | <b> $5 100% * the rest of it is plain\nsame line\nsame line\n same line", "b", "", 1),
             (None, "no id here, yet words enough for a document of its own", "b", "", 1), (305, "x y z w v u x y z w v k l m n o p q", "b", "", 1)]
    return rows + rows[-1:] * 2


def brute_lines(rows, limit):
    norm = [[re.sub("[ \t\x0b-\r]+", " ", lower(x)).strip(" ") for x in (t or "").split("\n")] for _, t, *_ in rows]
    held = collections.Counter((rows[i][2], x) for i, n in enumerate(norm) for x in set(n) if x)
    out = []
    for (i, t, host, *_), lines in zip(rows, norm, strict=True):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        grams = collections.Counter(tuple(w[k: k + 5]) for k in range(len(w) - 4))
        again = {p for k in range(len(w) - 4) if grams[tuple(w[k: k + 5])] > 1 for p in range(k, k + 5)}
        raw = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        gone = [x for x in lines if x and held[host, x] > limit]
        left = len(w) - sum(len(x.split(" ")) for x in gone)
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(raw) - len(set(raw)), len(again), failed,
                    not failed and left >= 10 and left >= 0.5 * len(w), len(gone), len(w) - left))
    return out


def test_line_frequency(spark):
    rows = line_rows(4)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = [tuple(r) for r in lf.judge_lines(docs, limit=4).collect()]
    want = brute_lines(rows, 4)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    verdict = {r[0]: r[7] for r in want}
    assert all(verdict[i] for i in range(5)) and not any(verdict[100 + i] for i in range(3)) and all(verdict[200 + i] for i in range(4))
    clean = lf.clean_documents(docs, limit=4)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == docs.columns and texts[0] == own(0) + "\r"
    assert texts[200] == rows[8][1] and clean.where("doc_id = 305").count() == 3 * verdict[305]
    none = spark.createDataFrame([], DOCS)
    assert lf.judge_lines(none).count() == lf.clean_documents(none).count() == 0


def test_line_frequency_runs_no_python(spark):
    plan = lf.judge_lines(spark.createDataFrame(line_rows(3), DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ------------------------------------------------------------------ 12 hard negatives
def brute_negatives(rows, every):
    v = [(i, (n + 1) % 10 if i % 7 == 0 else n, [math.floor(256 * x) for x in vec]) for i, n, vec in rows
         if i is not None and n is not None and vec is not None and len(vec) == 3 and all(x is not None and math.isfinite(x) for x in vec)]
    out = []
    anchors = {}
    for i, n, x in v:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (n, x)), (n, x))
    for a, (label, q) in anchors.items():
        scored = sorted((-sum(p * r for p, r in zip(q, x, strict=True)), i, n) for i, n, x in v if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            fits = [(i, -t) for t, i, n in scored if n != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(fits)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>, id string, score int"


@pytest.mark.parametrize("seed,labels,spread", [(1, 4, 1.0), (2, 10, 0.05), (3, 1, 1.0)])
def test_hard_negatives(spark, seed, labels, spread):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(6)]
    rows = [(i, rng.randrange(labels), [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(1, 400)]
    rows += [(1000 + i, rng.randrange(labels), rows[5][2]) for i in range(90)]                       # copies, ties
    rows += [(50, 1, [0.1, 0.2, 0.3]), (8, 0, [0.5, 0.5, 0.5]), (8, 0, [0.5, 0.5, 0.5]), (2000, 1, [0.0, 0.0, 0.0])]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (2050, None, [1.0, 1.0, 1.0]), (2100, 1, None), (2150, 1, [1.0, None, 1.0]), (2200, 1, [1.0, float("nan"), 1.0]),
             (2250, 1, [1.0, float("inf"), 1.0]), (2300, 1, [1.0]), (2350, 1, [])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)
    got = hn.mine_negatives(table, F.col("id") % 50 == 0, label=hn.shifted_label(), fanout=3, leaf_rows=12, region_rows=30, block_asks=4)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 50)


def test_tree_leaves_out_only_what_it_may():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (300, 4)), rng.normal(30, 1, (300, 4))]
    tree = hn.fit_tree(x, len(x), 4, 20)
    low, high = {}, {}

    def seen(node, d, own):
        for j in np.unique(own):
            low[node, j], high[node, j] = d[own == j].min(axis=0), d[own == j].max(axis=0)

    leaf = tree.descend(x, seen)
    tree.ranges = {n: np.stack([np.stack([f.get((n, j), np.full(len(p), e)) for j in range(len(p))], axis=1) for f, e in ((low, np.inf), (high, -np.inf))], -1)
                   for n, p in enumerate(tree.points)}
    q = x[::37]
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1))
    reach = tree.reached(q, np.full((len(q), 1), 2.0), np.full((len(q), 1), 3.0), 1e-9)
    inside = (d >= 2) & (d <= 3)
    for i in range(len(q)):
        assert reach[i][leaf[inside[i]]].all()
    assert tree.leaves > 20 and reach.mean() < 0.5


def test_hard_negatives_of_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hn.mine_negatives(none, F.col("id") % 50 == 0).count() == 0
    assert hn.mine_negatives(spark.createDataFrame([(50, 1, None, "", 1)], VECTORS), F.col("id") % 50 == 0).count() == 0
    same = spark.createDataFrame([(i, i % 2, [0.5, 0.5], "", 1) for i in range(300)], VECTORS)
    assert hn.mine_negatives(same, F.col("id") % 50 == 0, leaf_rows=8, region_rows=16).count() == 0  # all scores equal: none at 95 %


# ------------------------------------------------------------------ 13 interval search
def terms(t):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t or ""))


def brute_search(docs, items, k):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n_all, l_all = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(x for _, b in bags for x in b)
    out = []
    for item, t in items:
        scores = []
        for i, b in bags:
            m = 50 + (50 * sum(b.values()) * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[x] + 1))) * (10**9 * b[x] // (1000 * b[x] + 20 * m)) for x in set(terms(t)) if b[x])
            scores += [(-s, i)] if s > 0 else []
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_interval_search(spark):
    rng = random.Random(5)
    vocabulary = [f"W{i}" for i in range(60)] + ["über", "ÜBER", "1a", "日本", "é"]
    weight = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i * 3 % 211, " ".join(rng.choices(vocabulary, weight, k=rng.randrange(1, 60)))) for i in range(200)]
    docs += [(500 + i, docs[7][1]) for i in range(40)] + [(900, docs[3][1])] * 2                      # ties and repeated rows
    docs += [(901, None), (902, ""), (903, "-- ++\x7f"), (None, "W0 W1"), (904, "w0 " * 30_000), (905, "w1-w2_w3.w4")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(25)]
    items += [(30, None), (31, "nowhere else"), (None, "w3 w4"), (32, "W5 w5 w6"), (32, "w7"), (33, "")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int").repartition(2)
    want = brute_search(docs, items, 10)
    for block, chunk in ((7, 20), (4096, 200_000)):
        got = se.search(d, q, k=10, block_docs=block, chunk_terms=chunk)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert se.search(d.limit(0), q).count() == se.search(d, q.limit(0)).count() == 0


def test_bounds_leave_documents_unscored():
    rng = np.random.default_rng(1)
    ids, lists, impacts = np.arange(2000), [], []
    for t in range(8):
        pos = np.sort(rng.choice(2000, 400 if t else 30, replace=False))
        lists.append((pos, np.ones(len(pos), np.int64)))
        impacts.append(rng.integers(1, 100, len(pos)) * (1 if t else 50))
    index = se.BlockIndex(2000, lists, impacts)
    whole = np.zeros(2000, np.int64)
    for (pos, _), v in zip(lists, impacts, strict=True):
        whole[pos] += v
    docs, scores, seen = index.search(np.arange(8), ids, 10)
    best = np.lexsort((ids, -whole))[:10]
    assert (docs == best).all() and (scores == whole[best]).all() and seen < 1200


def test_index_holds_every_document_once(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 5}") for i in range(100)], "doc_id long, text string").repartition(4)
    index = se.build_index(docs, "doc_id", "text", 9)
    heads = index.where("ids IS NOT NULL").collect()
    assert sorted(x for r in heads for x in r["ids"]) == list(range(100)) and max(len(r["ids"]) for r in heads) <= 9
    (term,) = se.text_terms(pa.array(["a"])).__next__()[2].tolist()
    assert index.where(F.col("term") == term).agg(F.sum("df")).first()[0] == 100
