"""Operators on document texts against brute-force versions, and their handling of odd rows."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidence_spark.llm import op1_fingerprints as fp
from evidence_spark.llm import op3_mixing as mix
from evidence_spark.llm import op4_quality as quality
from evidence_spark.llm import op5_pieces as pieces
from evidence_spark.llm import op6_jaccard as jac
from evidence_spark.llm import op10_suffix_tree as lm
from evidence_spark.llm.words import mix64, shingles, string_words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 6000
ODD = [
    (1, "One two three four five six seven", "en", "src0", 3), (2, "", "en", "src1", 0), (3, None, None, None, None),
    (4, "one TWO three four five six seven", "en", "src0", 1), (5, " \n\t ", "de", "src1", 4), (6, LONG, "en", "src2", 9),
    (7, "a b", "en", "zzz", 1), (8, "a b", "en", "src3", 1), (8, "a b", "en", "src3", 1), (None, "no id at all", "en", "src0", 2),
    (None, None, None, None, None), (9, "ünï\u2581 côdé \U0001f600  two  spaces", "fr", "src0", 2), (9, "another text, same id", "fr", "src0", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns named like results."""
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS score", "2 AS copies", "3 AS node", "4 AS mark", "5 AS mix_copy").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]


# ------------------------------------------------------------------ words
def test_words_and_shingles():
    assert len(string_words("")) == len(string_words(" \t\r\n\x0b\x0c")) == 0
    assert (string_words("A b\xa0c É") == string_words("a  b\xa0c\nÉ")).all()
    assert len(string_words("A b\xa0c É")) == 3 and string_words("É")[0] != string_words("é")[0]
    vocabulary = [f"w{i}" for i in range(5000)] + ["", ] + [chr(300 + i) * (i % 9 + 1) for i in range(900)]
    distinct = {w for w in vocabulary if w}
    assert len(set(string_words(" ".join(vocabulary)).tolist())) == len(distinct)
    assert len(shingles(string_words("a b"), 3)) == 1 and len(shingles(string_words("a b c d"), 3)) == 2
    assert shingles(string_words("a b"), 3)[0] == shingles(string_words("A  b"), 3)[0] != shingles(string_words("b a"), 3)[0]


# ------------------------------------------------------------------ 1 fingerprints
def test_fingerprints_estimate_generalised_jaccard():
    rng, sampler, errors = np.random.default_rng(3), fp.WeightedSampler(), []
    for _ in range(120):
        a = [f"w{i}" for i in rng.integers(0, 60, 150)]
        b = a[: rng.integers(20, 150)] + [f"w{i}" for i in rng.integers(0, 60, 40)] + a[:30] * int(rng.integers(0, 3))
        x, y = (fp.SampledText(" ".join(t), sampler, 1) for t in (a, b))
        ca, cb = collections.Counter(a), collections.Counter(b)
        errors.append(fp.likeness(x.low, y.low) - sum((ca & cb).values()) / sum((ca | cb).values()))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_edited_fingerprint_is_that_of_the_edited_text():
    rng, sampler = np.random.default_rng(5), fp.WeightedSampler(16)

    def text(n):
        return "".join(f"w{rng.integers(0, 40)}" + rng.choice(["", ".", " ", "\n"]) + " " for _ in range(n))

    for n, m in [(0, 0), (0, 9), (1, 0), (2, 3), (5, 1), (6, 80), (40, 3), (90, 200), (300, 120)] * 6:
        a, b = text(n), text(m)
        own, after = fp.SampledText(a, sampler, 5), fp.SampledText(b, sampler, 5)
        edited = fp.edited_text(a, b)
        assert (fp.edited_minima(own, after, edited, 5) == fp.SampledText(edited, sampler, 5).low).all()
        assert (own.low == sampler.bag(own.terms)).all()


def test_fingerprint_rows(spark, odd, none):
    got = fp.fingerprint_edits(odd, buckets=4).collect()
    order = sorted(((i, t or "") for i, t, *_ in ODD), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want, sampler = collections.Counter(), fp.WeightedSampler()
    low = {t: fp.SampledText(t, sampler, 5).low for _, t in order}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        e = fp.SampledText(edited, sampler, 5).low
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.as_string(low[t]), fp.as_string(e),
              fp.likeness(low[t], e), fp.likeness(low[t], low[after]))] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    assert fp.fingerprint_edits(none).count() == 0
    one = fp.fingerprint_edits(spark.createDataFrame(ODD[:1], SCHEMA)).first()
    assert one["near_next"] == 1.0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = fp.fingerprint_edits(docs)
    by_text = rows.join(docs.select("doc_id", "text"), "doc_id").groupBy("text").agg(F.count_distinct("fingerprint").alias("n"))
    assert by_text.where("n > 1").count() == 0 and rows.count() == docs.count()


# ------------------------------------------------------------------ 3 mixing
def test_mixing_against_brute_force(odd, none):
    targets = {"src0": 2.0, "src1": 1.0, "src3": 3.0, "absent": 1.0, "off": 0.0}
    counts = collections.Counter(r[3] for r in ODD)
    have = {k: counts[k] for k in ("src0", "src1", "src3")}
    want = collections.Counter()
    for i, t, lang, source, n in ODD:
        key = hashlib.md5("|".join(["s", "" if i is None else str(i), t or ""]).encode()).hexdigest()
        u = int(key[:13], 16) / 2**52
        rate = targets[source] / 6.0 * sum(have.values()) / have[source] if source in have else 1.0
        k, p = 0, math.exp(-rate)
        total = p
        while u >= total:
            k += 1
            p *= rate / k
            total += p
        for c in range(k):
            want[(i, t, lang, source, n, c, hashlib.md5(f"{key}#{c}".encode()).hexdigest())] += 1
    got = mix.poisson_mix(odd, targets, seed="s")
    cols = ["doc_id", "text", "lang", "source", "n_chars", "mix_copy", "mix_key"]
    assert collections.Counter(tuple(r) for r in got.select(*cols).collect()) == want
    assert mix.poisson_mix(none, targets).count() == 0
    assert "Python" not in got._jdf.queryExecution().toString()


def test_poisson_cdf():
    for rate in (0.01, 1.0, 7.5, 900.0):
        cdf = mix.poisson_cdf(rate)
        assert cdf == sorted(cdf) and abs(cdf[-1] - 1) < 1e-9
        assert abs(sum(1 - x for x in cdf) - rate) < 1e-6 * max(rate, 1)
    assert mix.poisson_cdf(0.0) == []


def test_mixing_of_a_very_rare_source(spark, tmp_path):
    """One row has to fill a third of the mixture: split into parts, the same in SQL, and in number as asked for."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('t', id) AS text", "'en' AS lang",
                                          "if(id = 7, 'rare', if(id % 2 = 0, 'b', null)) AS source", "1L AS n_chars")
    targets = {"rare": 0.5, "b": 0.5}
    rates = mix.source_rates(docs, targets, None)
    assert rates["rare"] > 7000 and mix.parts_of(rates["rare"]) == math.ceil(rates["rare"] / mix.PART_RATE)
    assert max(len(mix.poisson_cdf(r / mix.parts_of(r))) for r in (*rates.values(), 1e7)) < 4 * mix.PART_RATE
    got = mix.poisson_mix(docs, targets, seed="s")
    assert "Python" not in got._jdf.queryExecution().toString()
    cols = ["doc_id", "text", "lang", "source", "n_chars", "mix_copy", "mix_key"]
    rows = [tuple(r) for r in got.select(*cols).collect()]
    rare = [r for r in rows if r[3] == "rare"]
    assert abs(len(rare) - rates["rare"]) < 6 * math.sqrt(rates["rare"]) and len({r[5] for r in rare}) == len(rare) == len({r[6] for r in rare})
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({mix.oracle(targets, 's')})").fetchall()
    assert collections.Counter(rows) == collections.Counter(want)


def test_mixing_meets_target_weights(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "concat('t', id) AS text", "'en' AS lang",
                                          "if(id % 3 = 0, 'hot', if(id % 3 = 1, 'b', 'c')) AS source", "1L AS n_chars")
    n = {r[0]: r[1] for r in mix.poisson_mix(docs, {"hot": 0.1, "b": 0.6, "c": 0.3}).groupBy("source").count().collect()}
    assert abs(n["hot"] - 4000) < 300 and abs(n["b"] - 24000) < 800 and abs(n["c"] - 12000) < 600


# ------------------------------------------------------------------ 4 quality
def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_quality_rows(spark, odd, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_quality(odd, no_labels).collect()
    assert len(got) == len(ODD) and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] * 2 + [(None, 1), (2, None)], "doc_id long, quality int")
    kept = quality.score_quality(odd, labels, keep=odd.columns)
    assert kept.count() == len(ODD) and set(odd.columns) < set(kept.columns) and len(kept.columns) == len(set(kept.columns))
    assert quality.score_quality(none, labels).count() == 0


def test_tree_rules_are_read_from_the_printed_forest():
    text = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 1 <= 0.5)
     If (feature 1 <= 0.25)
      Predict: 0.0
     Else (feature 1 > 0.25)
      Predict: 1.0
    Else (feature 1 > 0.5)
     Predict: 1.0
"""
    assert quality.tree_rules(text) == sorted([((1, "<=", 0.5),), ((1, "<=", 0.25),), ((1, "<=", 0.5), (1, ">", 0.25)), ((1, ">", 0.5),)])


# ------------------------------------------------------------------ 5 pieces
TEXTS = ["", " a", "a  b", "a\n b ", "x\u2581y", "  ", "\t", "h\u00e9llo w\u00f6rld \U0001f600 foo\n\n\nbar", "\u2581\u2581", "\n", " \n", "a" * 3000, "z\x00y \ufeff", LONG]


def test_pieces_are_lossless_and_known_to_the_library():
    import sentencepiece

    lattices = pieces.Lattices(pieces.load_vocabulary())
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids, off = lattices.encode(TEXTS, mix64(np.arange(len(TEXTS), dtype=np.uint64)))
    back = lattices.decode(ids, off)
    for k, t in enumerate(TEXTS):
        assert back[k].decode() == t
        if "\x00" not in t:
            assert sp.decode([int(i) for i in ids[off[k]: off[k + 1]]]) == t
    again, _ = pieces.Lattices(pieces.load_vocabulary()).encode(TEXTS[::-1], mix64(np.arange(len(TEXTS), dtype=np.uint64))[::-1])
    assert collections.Counter(again.tolist()) == collections.Counter(ids.tolist())


def test_segmentations_are_drawn_by_their_weight():
    v = pieces.load_vocabulary()
    lattices, n, alpha = pieces.Lattices(v, 0.3), 30_000, 0.3

    def every(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in v["pieces"]:
                for rest, w in every(s[k:]):
                    yield (v["pieces"][s[:k]][0], *rest), w + alpha * v["pieces"][s[:k]][1]

    weight = {s: math.exp(w) for s, w in every("\u2581there")}
    total = sum(weight.values())
    ids, off = lattices.encode(["there"] * n, mix64(np.arange(n, dtype=np.uint64)))
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True))
    assert set(seen) <= set(weight) and len(weight) > 5
    for s, w in weight.items():
        assert abs(seen[s] / n - w / total) < 0.015


def test_piece_rows(spark, odd, none):
    got = pieces.encode_decode(odd)
    rows = got.collect()
    assert len(rows) == len(ODD) and all(r["lossless"] for r in rows)
    want = collections.Counter((i, len(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ODD)
    assert collections.Counter((r["doc_id"], r["n_chars"], r["decoded_sha256"]) for r in rows) == want
    second = pieces.encode_decode(odd.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, second))
    assert pieces.encode_decode(none).count() == 0
    back = pieces.decode_pieces(got).select("doc_id", "text").collect()
    assert collections.Counter(map(tuple, back)) == collections.Counter((i, t or "") for i, t, *_ in ODD)


# ------------------------------------------------------------------ 6 Jaccard join
def brute_components(rows, width=3, percent=90):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset([tuple(w)] if 0 < len(w) < width else zip(*(w[k:] for k in range(width)), strict=False)) if w else frozenset())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    big = 1 << 62
    low = {g: min((rows[k][0] for k in ks), key=lambda i: big if i is None else i) for g, ks in groups.items()}
    return [(rows[k][0], len(sets[k]), low[find(k)]) for k in range(len(rows))]


def near_copies(seed, n, size, edits):
    """n chained near copies: every one edits its predecessor, so likeness fades along the chain."""
    rng = np.random.default_rng(seed)
    text, out = [f"{seed}w{i}" for i in rng.integers(0, 10_000, size)], []
    for _ in range(n):
        out.append(" ".join(text))
        text = list(text)
        for _ in range(edits):
            text[rng.integers(0, size)] = f"e{rng.integers(0, 10**9)}"
    return out


def test_components_against_brute_force(spark, monkeypatch):
    texts = [t for s, (n, size, edits) in enumerate([(12, 60, 1), (9, 300, 4), (14, 40, 2), (6, 12, 1), (5, 3, 1), (20, 150, 6)])
             for t in near_copies(s, n, size, edits)]
    rng = np.random.default_rng(1)
    base = [f"h{i}" for i in range(200)]
    for _ in range(40):  # a hub: all near one text, not all near each other
        t = list(base)
        for k in rng.integers(0, 200, int(rng.integers(0, 5))):
            t[k] = f"x{rng.integers(0, 10**9)}"
        texts.append(" ".join(t))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)) + 100, texts, strict=True)] + [(r[0], r[1]) for r in ODD if r[1] != LONG]
    want = collections.Counter(brute_components(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert collections.Counter(tuple(r) for r in jac.jaccard_components(df).collect()) == want
    five = collections.Counter(brute_components(rows, 5, 80))
    assert collections.Counter(tuple(r) for r in jac.jaccard_components(df, width=5, percent=80).collect()) == five


def test_blocks_find_the_same_candidates(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), 5, int(n), 40, int(n) % 3, *[int(x) for x in rng.integers(0, 4, 4)], *[0] * 12) for k in range(3) for n in range(30)]
    members = spark.createDataFrame(rows, "key long, band int, node long, n long, root long, " + ", ".join(f"{c} long" for c in jac.SHORT))
    whole, split = (collections.Counter(map(tuple, jac.cross_candidates(members, 90, block=b, unit_rows=u).collect())) for b, u in ((512, 10_000), (4, 7)))
    want = set()
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[2] < y[2] and x[4] != y[4]:
                bits = sum(bin(p ^ q).count("1") for p, q in zip(x[5:], y[5:], strict=True))
                if bits * 190 <= 80 * 10:
                    want.add((5, x[2], y[2]))
    assert whole == split == collections.Counter(want) and want


def test_candidates_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """A passage that many texts share, short or long ones: few candidates a text reach the joins."""
    rng = np.random.default_rng(3)

    def fresh(n):
        return [f"u{x}" for x in rng.integers(0, 10**12, n)]

    short, long = fresh(60), fresh(400)
    texts = [" ".join(fresh(25) + short + fresh(25)) for _ in range(150)] + [" ".join(fresh(1200) + long + fresh(1200)) for _ in range(50)]
    texts += [f"{t} end" for t in texts[::40]] + near_copies(4, 30, 200, 2)
    rows = list(enumerate(texts))
    seen = []

    def counted(pairs, near, *rest):
        seen.append((pairs.count(), near.count()))
        return verified(pairs, near, *rest)

    verified = jac.verified
    monkeypatch.setattr(jac, "verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jac.jaccard_components(df, width=5, percent=80).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(brute_components(rows, 5, 80))
    assert seen[0][0] <= jac.HUBS * seen[0][1]
    assert sum(pairs for pairs, _ in seen[1:]) < 300


def test_leading_candidates_name_the_buckets_of_the_others(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), 5, int(n), 40, int(n) % 7, *[int(x) for x in rng.integers(0, 4, 4)], *[0] * 12) for k in range(3) for n in rng.permutation(60)[:40]]
    members = spark.createDataFrame(rows, "key long, band int, node long, n long, root long, " + ", ".join(f"{c} long" for c in jac.SHORT))
    for block, unit in ((512, 10_000), (8, 20)):
        every = {tuple(r) for r in jac.cross_candidates(members, 90, block=block, unit_rows=unit).collect()}
        found = jac.compared(members, 90, True, block=block, unit_rows=unit).collect()
        first, left = {(r["band"], r["a"], r["b"]) for r in found if r["key"] is None}, {r["key"] for r in found if r["key"] is not None}
        held = {k: {r[2] for r in rows if r[0] == k} for k in left}
        assert first < every and all(any(a in h and b in h for h in held.values()) for _, a, b in every - first)


def test_folds_never_show_more_bits_than_whole_sketches():
    rng = np.random.default_rng(6)
    lists = [rng.integers(-2**63, 2**63 - 1, n) for n in (40, 40, 900, 900, 230, 230)]
    cuts = np.cumsum([0] + [len(x) for x in lists])
    words = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(lists)))
    short, more = jac.folds(words)
    assert [len(x) for x in short] == [16] * 6 and [len(x) for x in more] == [0, 0, 80, 80, 32, 32]
    x, y = np.array([0, 2, 4]), np.array([1, 3, 5])
    bits = jac.fold_bits(more, x, y)
    for k in range(3):
        whole = int(np.bitwise_count((lists[x[k]] ^ lists[y[k]]).view(np.uint64)).sum())
        low = sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(short[int(x[k])].as_py(), short[int(y[k])].as_py(), strict=True))
        assert low <= whole and bits[k] <= whole and (k == 0 or low <= bits[k])


def test_band_and_difference_bounds():
    lows = jac.band_table(90, 5000)
    band = np.searchsorted(lows, np.arange(5001), side="right") - 1
    for b in range(1, 4000, 7):
        for a in range(-(-90 * b // 100), b + 1):
            assert band[b] - band[a] <= 1
    for a, b in ((9, 10), (95, 100), (50, 50), (19, 19)):
        for common in range(min(a, b) + 1):
            links = 100 * common >= 90 * (a + b - common)
            assert links == (a + b - 2 * common <= jac.max_difference(a + b)) or not links


def test_jaccard_rows(odd, none):
    got = jac.jaccard_components(odd)
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(brute_components([(r[0], r[1]) for r in ODD]))
    assert jac.jaccard_components(none).count() == 0
    kept = jac.one_per_component(odd)
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    # 1 and 4 are equal but for case, 7 and twice 8 are equal; texts without words all stay
    assert collections.Counter(rows) == collections.Counter(
        [(r[0], r[1]) for r in ODD if r[0] not in (4, 8) or r[1] is None])
    assert jac.one_per_component(none).count() == 0


# ------------------------------------------------------------------ 10 language model
def test_language_model_base_score_and_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = docs.select("doc_id", "text").collect()
    rows = {r["doc_id"]: r for r in lm.score_texts(docs).collect()}
    counts = collections.Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts:
        tokens, r = [*words(t), None], rows[i]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert abs(r["base_score"] - base) < 1e-6 and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.05 * sum(r["n_tokens"] for r in held)


class BruteTree:
    """The suffix tree in dictionaries of word tuples; None is the end mark."""

    def __init__(self, texts, depth):
        self.counts, self.depth = collections.Counter(), depth
        for t in texts:
            seq = [None, *words(t), None]
            self.counts.update((w,) for w in seq[1:])
            self.counts.update(tuple(seq[i: i + n]) for n in range(2, depth + 2) for i in range(len(seq) - n + 1))
        self.total = sum(c for g, c in self.counts.items() if len(g) == 1)
        self.floor = self.total + 0.5 * (sum(len(g) == 1 for g in self.counts) + 1)
        self.states, followers = {}, collections.defaultdict(dict)
        for g, c in self.counts.items():
            if len(g) > 1 and c >= 2:
                followers[g[:-1]][g[-1]] = c
        for ctx in sorted(followers, key=len):
            after, n = followers[ctx], self.counts[ctx]
            q = {x: self.p(ctx[1:], x) for x in after}
            p = {x: (c + q[x]) / (n + 1) for x, c in after.items()}
            left, left_q = max(1 - sum(p.values()), 1e-12), max(1 - sum(q.values()), 1e-12)
            kl = sum(p[x] * math.log(p[x] / q[x]) for x in p) + left * math.log(left / left_q)
            if n * kl > 0.5 * len(p) * math.log(max(self.total, 2)):
                self.states[ctx] = (p, left / left_q)

    def p(self, ctx, x):
        if not ctx:
            return (self.counts[(x,)] + 0.5) / self.floor
        if ctx not in self.states:
            return self.p(ctx[1:], x)
        p, rest = self.states[ctx]
        return p[x] if x in p else rest * self.p(ctx[1:], x)

    def score(self, text):
        seq = [None, *words(text), None]
        return sum(math.log10(self.p(tuple(seq[max(0, i - self.depth): i]), seq[i])) for i in range(1, len(seq)))


def trained(i):
    return zlib.crc32(str(i).encode()) % 5 != 1


@pytest.mark.parametrize("depth", [2, 3])
def test_language_model_against_brute_force(spark, monkeypatch, depth):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1]) for r in docs.collect()]
    tree = BruteTree([t for i, t in rows if trained(i)], depth)
    assert {len(c) for c in tree.states} >= {1, 2}
    monkeypatch.setattr(lm, "RUN_TOKENS", 3000)
    for frequent in (lm.FREQUENT, (50, 50)):  # what is broadcast changes no result
        got = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, depth=depth, frequent_rows=frequent).collect()}
        assert got.keys() == {i for i, _ in rows}
        assert max(abs(got[i] - tree.score(t)) / len(t.split(" ")) for i, t in rows) < 1e-5  # values are 32-bit floats


def test_every_state_is_a_distribution(spark):
    text = " ".join(f"{a} {b}" for a, b in [("the", "cat"), ("the", "dog"), ("a", "cat"), ("the", "cat")] * 60)
    texts = [text + f" x{i}" for i in range(20)]
    tree = BruteTree(texts, 2)
    symbols = [g[0] for g in tree.counts if len(g) == 1]
    assert {len(c) for c in tree.states} == {1, 2}
    for ctx in tree.states:
        assert abs(sum(tree.p(ctx, x) for x in [*symbols, "unseen"]) - 1) < 1e-9
    ids = [i for i in range(100) if trained(i)][:20]
    got = lm.score_texts(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()
    want = dict(zip(ids, texts, strict=True))
    assert max(abs(r["score"] - tree.score(want[r["doc_id"]])) for r in got) < 1e-3  # 961 tokens, 32-bit floats


def test_a_passage_that_occurs_twice_is_in_the_model(spark):
    rng = np.random.default_rng(3)
    ids = [i for i in range(600) if trained(i)][:302]
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 400, 200))) for i in ids[2:]]
    passage = " ".join(f"w{x}" for x in rng.integers(0, 400, 50)) + " " + " ".join(f"p{x}" for x in range(20))
    got = {r["doc_id"]: r for r in lm.score_texts(spark.createDataFrame(rows + [(i, passage) for i in ids[:2]], "doc_id long, text string")).collect()}
    for i in ids[:2]:
        assert got[i]["score"] > got[i]["base_score"] + 1.5 * 20


def test_language_model_rows(spark, odd, none):
    got = lm.score_texts(odd).collect()
    assert len(got) == len(ODD) and all(np.isfinite([r["score"], r["base_score"]]).all() for r in got)
    want = collections.Counter((i, len(words(t)) + 1) for i, t, *_ in ODD)
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
    assert lm.score_texts(none).count() == 0
    alone = lm.score_texts(spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string"))
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in alone.collect()} == {(0, 0, 0.0, 0.0)}


def test_a_rare_passage_of_a_large_table_is_in_the_model(spark):
    # 1,000,000 training tokens: five occurrences are far less than 1e-5 of them
    rng = np.random.default_rng(10)
    ids = {side: [i for i in range(400) if (zlib.crc32(str(i).encode()) % 5 == 1) == side] for side in (True, False)}
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 500, 5000))) for i in ids[False][:200]]
    passage = " ".join(f"rare{x}" for x in range(30))
    rows += [(i, f"{passage} w{i}") for i in ids[False][200:205]] + [(ids[True][0], passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = next(r for r in lm.score_texts(docs).collect() if r["doc_id"] == ids[True][0])
    assert got["train_tokens"] > 1_000_000 and got["score"] > got["base_score"] + 2 * 30


def test_suffix_tree_leaves_no_gram_tables_behind(spark):
    """Counts and grams of a level are removed once the next table is written: disk holds one level's tables at a time."""
    import glob

    from evidence_spark.llm.op10_suffix_tree import score_texts
    from evidence_spark.session import ensure_checkpoint_dir

    at = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/lm-*"
    before = set(glob.glob(at))
    docs = spark.createDataFrame([(i, "a b c d a b c d a b") for i in range(40)], "doc_id long, text string")
    got = score_texts(docs).collect()
    left = [p.split("/")[-1] for p in set(glob.glob(at)) - before]
    assert len(got) == 40 and {r["n_tokens"] for r in got} == {11}
    assert [p for p in left if p.startswith("lm-level")] and not [p for p in left if p.startswith(("lm-counts", "lm-grams"))]
