"""Operators on pages and vectors against brute-force versions, and their handling of odd rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_spark.llm import op2_html as html
from evidence_spark.llm import op7_neighbours as ann
from evidence_spark.llm import op8_urls as urls
from evidence_spark.llm import op9_warc as warc

SF = "/root/testdata/sf0.01"
BIG = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
TRICKY = "x" * 100 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n\u00e9\U0001f600"
PAGES = [
    (1, "http://a.net/x", "<p>one</p>"), (2, None, None), (3, "no scheme", ""), (4, "HTTPS://A.Example.NET/en/x?y#z", TRICKY),
    (5, "http://b.org/fr/", TRICKY), (6, "http://com/", BIG), (6, "http://com/", BIG), (None, "http://x.net", TRICKY), (7, "http://x\r\n .com/de/", "y" * 99),
    (8, "", "y" * 99), (9, "http://example.com/de/1", TRICKY), (9, "http://example.com/de/1", "z" * 200), (None, None, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr(
        "*", "1 AS text", "2 AS payload_digest", "3 AS rule", "4 AS host", "5 AS refers_to").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "page_id long, url string, html string")


# ------------------------------------------------------------------ 2 HTML
TREE = html.fit_tree(*html.labelled_blocks())
PARA = "The ferry was late again this morning, and the people on the quay read their papers twice over. "


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<p>", ""), ("<nav><a href=/>Home</a></nav>", ""),
    (f"<header><h1>Site</h1></header><nav><ul><li><a>A</a></ul></nav><article><h1>T &lt;1&gt;</h1><p>{PARA}<br>x</p><p>a&nbsp; b"
     f"</article><footer>{PARA}</footer>", f"T <1>\n{PARA}x\na b"),
    (f"<article><p>{PARA}</p><script>if (a<b) '<p>no</p>'</script><style>p{{}}</style><noscript>no</noscript><!-- <p>no</p> --><p>End.</p></article>",
     f"{PARA.strip()}\nEnd."),
    (f"<article><p>{PARA}</p></article><section id=comments><h2>2 comments</h2><p>{PARA}</p></section>", PARA.strip()),
    (f"<div class='cookie-banner'>{PARA}</div><main><p>{PARA}</p><aside>{PARA}</aside><form><p>{PARA}</p></form></main>", PARA.strip()),
    (f"<div class=sidebar>{PARA}</div><div class=ad>{PARA}</div><article><p>{PARA}</p><div class='advert'>{PARA}</div></article>", PARA.strip()),
    (f"<article><h1>Head</h1><p>{PARA}<p>{PARA}<p>Short.</article>", f"Head\n{PARA.strip()}\n{PARA.strip()}\nShort."),
    (f"<p>{PARA * 2}</p><p>{PARA * 2}</p>", f"{(PARA * 2).strip()}\n{(PARA * 2).strip()}"),
    (f"<ARTICLE><P>&eacute;&#233;&#xe9; &unknown; &amp</P><P>{PARA}</P></ARTICLE>", f"\u00e9\u00e9\u00e9 &unknown; &\n{PARA.strip()}"),
    (f"<title>T</title><article><p>{PARA}", PARA.strip()),
])
def test_main_text(page, text):
    assert html.main_text(page, TREE) == text


def test_main_text_of_the_pages(spark):
    """The pages' articles are marked up; a plain reading of the marked part must give the same text."""
    import html as lib

    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in html.extract_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in rows:
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = (" ".join(lib.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)[^>]*>", article))
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_labelled_table_is_learned():
    x, y = html.labelled_blocks()
    assert ((html.tree_scores(TREE, x) >= 0.5) == y).mean() > 0.95 and set(y) == {0, 1}
    assert html.fit_tree(x[:0], y[:0]) == 0.0


def test_html_rows(pages, none):
    got = html.extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert collections.Counter((r["page_id"], r["url"]) for r in rows) == collections.Counter((i, u) for i, u, _ in PAGES)
    by = collections.defaultdict(set)
    for r in rows:
        by[r["page_id"]].add(r["text"])
    assert by[2] == by[3] == {""} and by[6] == {"\n".join(["word & word"] * 20_000)}
    assert html.extract_text(none).count() == 0


# ------------------------------------------------------------------ 7 neighbours
def brute(ids, x, k):
    out = []
    for q in np.flatnonzero(np.array(ids) % 20 == 0):
        score = x @ x[q]
        order = [o for o in np.lexsort((ids, -score)) if ids[o] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[o]), score[o]) for r, o in enumerate(order)]
    return out


def test_recall_on_the_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(table, table.where("vec_id % 20 = 0")).collect()
    rows = table.collect()
    want = brute([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=float), 20)
    assert len(got) == len(want)
    assert len({(r[0], r[2]) for r in got} & {(w[0], w[2]) for w in want}) >= 0.9 * len(want)
    score = {(w[0], w[2]): w[3] for w in want}
    assert all(abs(score[r[0], r[2]] - r["score"]) < 1e-12 for r in got if (r[0], r[2]) in score)
    for q, rs in collections.Counter(r["query_id"] for r in got).items():
        assert rs == 20


def test_small_tables_are_exact_with_ties_and_unequal_norms(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((70, 6)).round(1) * rng.integers(1, 9, (70, 1))
    x[10:40] = x[3]  # one vector that stands thirty times
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 20 = 0"), block_rows=16, block_queries=2).collect()
    want = brute(np.arange(70), x, 20)
    assert [(r[0], r[1], r[2]) for r in sorted(got)] == [w[:3] for w in sorted(want)]
    assert np.allclose([r[3] for r in sorted(got)], [w[3] for w in sorted(want)], atol=1e-12)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (20, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, [2.0, 1.0]),
            (None, [1.0, 1.0]), (40, [1.0, 1.0]), (40, [1.0, 1.0]), (8, [-inf, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS cell", "3 AS vec")
    got = sorted(tuple(r) for r in ann.search(df, df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 7, 2.0), (0, 2, 40, 1.0), (0, 3, 40, 1.0), (40, 1, 7, 3.0), (40, 2, 0, 1.0)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df, df.limit(0)).count() == 0


# ------------------------------------------------------------------ 8 urls
def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = re.match(r"[^/?#]*", url.partition("://")[2], re.S)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest)
        path = re.split("[?#]", url.partition("://")[2][len(rest):])[0]
    best = None
    for say, rule in urls.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = say, rule
    return host, path, best


def test_rules_against_brute_force(spark, pages, none):
    more = ["http://net/", "http://xnet/", "http://net", "http://a.net/?q", "ftp://EXAMPLE.com/de/#x", "http://sub.example.com/de", "http://o.org/fr/x",
            "://org/fr/", "http://example.net/en/", "http://example.net/EN/", "a://b://c.net/", "http://\u0130.NET/", "http://u@h.net:80/x", "http://a\nb.net/\nx"]
    df = pages.select("page_id", "url").unionByName(spark.createDataFrame(list(enumerate(more, 100)), "page_id long, url string")).unionByName(
        spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id + 1000 AS page_id", "url"))
    rows = df.collect()
    got = urls.filter_urls(df).collect()
    want = collections.Counter((r["page_id"], *judge(r["url"])[:2], (judge(r["url"])[2] or (None, None))[1]) for r in rows)
    assert collections.Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == want
    say = {rule: s for s, rule in urls.RULES}
    assert all(r["verdict"] == say[r["rule"]] for r in got if r["rule"]) and all(r["verdict"] in ("allow", "block") for r in got)
    assert urls.filter_urls(none).count() == 0
    one_sided = urls.filter_urls(spark.createDataFrame([(1, "http://a.net/"), (2, "http://q.com/")], "page_id long, url string")).collect()
    assert {(r["page_id"], r["verdict"]) for r in one_sided} == {(1, "block"), (2, "allow")}


def test_url_model_on_rows_it_has_not_seen(spark):
    """Train on the rule-judged urls of one half of the hosts, ask for those of the other half."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    base = df.select(urls.url_host(F.col("url")).alias("host"), urls.url_path(F.col("url")).alias("path"))
    rule, verdict = urls.match_rule(F.col("host"), F.col("path"))
    rows = base.withColumn("verdict", verdict).where(rule.isNotNull()).withColumn("side", F.crc32(F.col("host").cast("binary")) % 2)
    model = urls.train_url_model(rows.where("side = 0"))
    out = model.transform(urls.featurise(rows.where("side = 1"))).select((F.col("prediction") == (F.col("verdict") == "block").cast("int")).alias("ok"))
    assert out.agg(F.avg(F.col("ok").cast("int"))).first()[0] > 0.95


def test_character_grams(spark):
    df = spark.createDataFrame([("ab", ""), ("", "/x")], "host string, path string")
    got = [sorted(r[0]) for r in df.select(urls.char_grams(F.col("host"), F.col("path"))).collect()]
    assert got[0] == sorted(["h:^a", "h:ab", "h:b$", "h:^ab", "h:ab$", "h:^ab$", "p:^$", "p:^$", "p:^$"])
    assert got[1] == sorted(["h:^$", "h:^$", "h:^$", "p:^/", "p:/x", "p:x$", "p:^/x", "p:/x$", "p:^/x$"])


# ------------------------------------------------------------------ 9 archives
def test_archive_round_trip(pages, none):
    first = {}
    for i, _, h in PAGES:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = collections.Counter()
    for i, _, h in PAGES:
        body = (h or "").encode()
        copy = h in first and i != first[h]
        want[(i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if copy else "response", first[h] if copy else None)] += 1
    got = warc.roundtrip(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert warc.roundtrip(none).count() == 0


def test_archive_files_hold_each_payload_once(spark, pages, tmp_dir):
    path = f"{tmp_dir}/warc"
    warc.write_warc(warc.warc_records(pages, warc.resolve_revisits(warc.payload_headers(pages))), path, records_per_file=3)
    records = [r for f in spark.read.format("binaryFile").load(path).collect() for r in warc.parse_warc(f["content"])]
    assert len(records) == len(PAGES)
    payload = [block.partition(b"\r\n\r\n")[2] for head, block in records if head["warc-type"] == "response"]
    assert payload.count(TRICKY.encode()) == 1 and all(b"" == block.partition(b"\r\n\r\n")[2] for head, block in records if head["warc-type"] == "revisit")
    assert {head["warc-target-uri"] for head, _ in records} >= {"http://a.net/x", "http://x%20%20%20.com/de/"}
    raw = warc.write_warc(warc.warc_records(pages, warc.resolve_revisits(warc.payload_headers(pages))), f"{tmp_dir}/plain", compression="none")
    assert warc.resolve_archive(warc.read_warc(spark, raw)).count() == len(PAGES)


def test_changed_payload_fails_the_reading(spark, tmp_dir):
    df = spark.createDataFrame([(1, "u", "a" * 200)], "page_id long, url string, html string")
    records = warc.warc_records(df, warc.resolve_revisits(warc.payload_headers(df))).select(F.replace("value", F.lit("aaaa"), F.lit("aaab")).alias("value"))
    warc.write_warc(records, f"{tmp_dir}/w")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.resolve_archive(warc.read_warc(spark, f"{tmp_dir}/w")).collect()
