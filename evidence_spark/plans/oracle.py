"""DuckDB SQL for the correctness check of every registered query.

Written independently of the Spark code: BM25 and the lexical judge here are token-level
relational plans (unnest, group, join on (uuid, token)); the library uses posting lists
inside a row. Doubles are rounded with ``floor(x * 10^d + 0.5) / 10^d`` in both.
"""

from __future__ import annotations

from evidence_spark.plans.fixtures import oracle_sql

PAT = r"(?s)##begin_quote##\s*(.*?)\s*##end_quote##"


def parse(expr: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all(coalesce({expr}, ''), '{PAT}', 1), "
        f"lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
    )


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def r4(expr: str, d: int = 4) -> str:
    s = 10**d
    return f"(floor(CAST({expr} AS DOUBLE) * {s} + 0.5) / {s} + 0.0)"


def fmt(expr: str) -> str:
    s1 = f"regexp_replace({strip(expr)}, '^\\x{{FEFF}}+|\\x{{FEFF}}+$', '', 'g')"
    return (
        f"CASE WHEN {expr} IS NULL THEN 0.0 "
        f"WHEN regexp_replace({s1}, '\\s', '', 'g') = '' THEN 0.0 "
        f"WHEN NOT regexp_matches({s1}, '{PAT}') THEN 0.0 "
        f"WHEN regexp_replace(regexp_replace({s1}, '{PAT}', '', 'g'), '\\s', '', 'g') <> '' THEN 0.0 "
        f"ELSE 1.0 END"
    )


def clamp01(e: str) -> str:
    return f"greatest(0.0, least(1.0, {e}))"


def f1(p: str, r: str) -> str:
    cp, cr = clamp01(p), clamp01(r)
    return (
        f"CASE WHEN {p} IS NULL OR {r} IS NULL THEN NULL "
        f"WHEN {cp} + {cr} = 0 THEN 0.0 ELSE 2.0 * ({cp} * {cr}) / ({cp} + {cr}) END"
    )


def bm25_ctes(gold_src: str, pair_src: str) -> list[tuple[str, str]]:
    """Relational BM25. ``gold_src(uuid, gt)`` one row per document,
    ``pair_src(uuid, model, resp)`` one row per pair. Produces ``bm(uuid, model, bm25)``
    plus the intermediate tables gq, gtf, gdl, gn, gidf, gw, rq, rbest."""
    return [
        ("gq", f"SELECT uuid, unnest(qs) AS q, generate_subscripts(qs, 1) - 1 AS gidx "
               f"FROM (SELECT uuid, {parse('gt')} AS qs FROM {gold_src})"),
        ("gtok", "SELECT uuid, gidx, unnest(string_split_regex(lower(q), '\\s+')) AS token FROM gq"),
        ("gtf", "SELECT uuid, gidx, token, count(*) AS tf FROM gtok GROUP BY ALL"),
        ("gdl", "SELECT uuid, gidx, count(*) AS dl FROM gtok GROUP BY ALL"),
        ("gn", "SELECT uuid, count(*) AS n_quotes, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl "
               "FROM gdl GROUP BY uuid"),
        ("gdf", "SELECT uuid, token, count(*) AS df FROM gtf GROUP BY ALL"),
        ("graw", "SELECT d.uuid, d.token, d.df, "
                 "ln(n.n_quotes - d.df + 0.5) - ln(d.df + 0.5) AS raw "
                 "FROM gdf d JOIN gn n USING (uuid)"),
        ("gmean", "SELECT uuid, avg(raw) AS mean FROM graw GROUP BY uuid"),
        ("gidf", "SELECT r.uuid, r.token, r.df, "
                 "CASE WHEN r.raw < 0 THEN 0.25 * m.mean ELSE r.raw END AS idf "
                 "FROM graw r JOIN gmean m USING (uuid)"),
        ("gw", "SELECT t.uuid, t.gidx, t.token, "
               "i.idf * (CAST(t.tf AS DOUBLE) * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * CAST(l.dl AS DOUBLE) / n.avgdl))) AS w "
               "FROM gtf t JOIN gidf i USING (uuid, token) JOIN gdl l USING (uuid, gidx) JOIN gn n USING (uuid)"),
        ("rq", f"SELECT uuid, model, unnest(qs) AS q, generate_subscripts(qs, 1) - 1 AS ridx "
               f"FROM (SELECT uuid, model, {parse('resp')} AS qs FROM {pair_src})"),
        ("rtf", "SELECT uuid, model, ridx, token, count(*) AS qf FROM "
                "(SELECT uuid, model, ridx, unnest(string_split_regex(lower(q), '\\s+')) AS token FROM rq) "
                "GROUP BY ALL"),
        ("rs", "SELECT r.uuid, r.model, r.ridx, w.gidx, sum(r.qf * w.w) AS s "
               "FROM rtf r JOIN gw w USING (uuid, token) GROUP BY ALL"),
        ("rbest", "SELECT q.uuid, q.model, q.ridx, "
                  "CASE WHEN count(s.gidx) < max(n.n_quotes) THEN greatest(coalesce(max(s.s), 0.0), 0.0) "
                  "ELSE max(s.s) END AS best "
                  "FROM rq q JOIN gn n USING (uuid) "
                  "LEFT JOIN rs s ON s.uuid = q.uuid AND s.model = q.model AND s.ridx = q.ridx GROUP BY ALL"),
        ("rsys", "SELECT uuid, model, sum(best) AS sys FROM rbest GROUP BY ALL"),
        ("ps", "SELECT p.uuid, p.gidx AS qidx, w.gidx, sum(p.tf * w.w) AS s "
               "FROM gtf p JOIN gw w USING (uuid, token) GROUP BY ALL"),
        ("pbest", "SELECT g.uuid, g.gidx, "
                  "CASE WHEN count(s.gidx) < max(n.n_quotes) THEN greatest(coalesce(max(s.s), 0.0), 0.0) "
                  "ELSE max(s.s) END AS best "
                  "FROM gq g JOIN gn n USING (uuid) "
                  "LEFT JOIN ps s ON s.uuid = g.uuid AND s.qidx = g.gidx GROUP BY ALL"),
        ("perfect", "SELECT uuid, sum(best) AS perfect FROM pbest GROUP BY uuid"),
        ("bm", f"SELECT p.uuid, p.model, CASE WHEN n.n_quotes IS NULL OR s.sys IS NULL THEN 0.0 "
               f"WHEN abs(pf.perfect) < 1e-12 THEN 0.0 "
               f"ELSE {r4('least(1.0, s.sys / pf.perfect)')} END AS bm25 "
               f"FROM {pair_src} p LEFT JOIN gn n USING (uuid) "
               f"LEFT JOIN rsys s ON s.uuid = p.uuid AND s.model = p.model "
               f"LEFT JOIN perfect pf ON pf.uuid = p.uuid"),
    ]


# samples of the evaluation: gold and inference non-empty (P14), no prior scores
SAMPLES = (
    "samples",
    "SELECT t.uuid, i.model, t.quotes AS gt, i.quotes AS resp "
    "FROM fx_testset t JOIN fx_inf i ON i.uuid = t.uuid "
    "WHERE t.quotes IS NOT NULL AND t.quotes <> '' AND i.quotes IS NOT NULL AND i.quotes <> ''",
)
GOLD = ("gold", "SELECT uuid, gt FROM samples GROUP BY uuid, gt")


def scored_ctes(judge: str = "table", samples=SAMPLES) -> list[tuple[str, str]]:
    """T11 results ``res(uuid, model, status, recall, precision, f1, bm25, format_score)``."""
    ctes = [samples, GOLD] + bm25_ctes("gold", "samples")
    if judge == "table":
        judged = (
            "judged",
            f"SELECT s.uuid, s.model, s.resp, len({parse('s.gt')}) AS ng, len({parse('s.resp')}) AS nr, "
            "j.recall, j.precision, j.uuid IS NOT NULL AS ok "
            "FROM samples s LEFT JOIN fx_judgments j ON j.uuid = s.uuid AND j.model = s.model",
        )
    elif judge == "stub":
        judged = (
            "judged",
            f"SELECT s.uuid, s.model, s.resp, len({parse('s.gt')}) AS ng, len({parse('s.resp')}) AS nr, "
            "CASE WHEN length(resp) % 7 > 0 THEN CAST(length(resp) % 5 AS DOUBLE) / 4 END AS recall, "
            "CASE WHEN length(resp) % 7 > 0 THEN CAST(length(gt) % 5 AS DOUBLE) / 4 END AS precision, "
            "length(resp) % 7 > 0 AS ok FROM samples s",
        )
    else:
        ctes += lexical_ctes()
        judged = (
            "judged",
            f"SELECT s.uuid, s.model, s.resp, len({parse('s.gt')}) AS ng, len({parse('s.resp')}) AS nr, "
            "l.recall, l.precision, TRUE AS ok FROM samples s JOIN lex l USING (uuid, model)",
        )
    repaired = (
        "repaired",
        "SELECT *, CASE WHEN coalesce(recall, 0) > 0 AND coalesce(precision, 0) = 0 AND ng > 0 AND nr > 0 "
        f"THEN {r4('greatest(CAST(1 AS DOUBLE) / nr, coalesce(recall, 0) * ng / nr)')} "
        "ELSE precision END AS p2 FROM judged",
    )
    res = (
        "res",
        "SELECT j.uuid, j.model, "
        "CASE WHEN NOT ok THEN 'judge_error' WHEN recall IS NULL OR p2 IS NULL THEN 'crash' ELSE 'scored' END AS status, "
        "CASE WHEN ok AND recall IS NOT NULL AND p2 IS NOT NULL THEN recall END AS recall, "
        "CASE WHEN ok AND recall IS NOT NULL AND p2 IS NOT NULL THEN p2 END AS precision, "
        f"CASE WHEN ok AND recall IS NOT NULL AND p2 IS NOT NULL THEN {f1('p2', 'recall')} END AS f1, "
        "CASE WHEN ok AND (recall IS NULL OR p2 IS NULL) THEN NULL ELSE b.bm25 END AS bm25, "
        f"CASE WHEN ok AND (recall IS NULL OR p2 IS NULL) THEN NULL ELSE {fmt('j.resp')} END AS format_score "
        "FROM repaired j JOIN bm b ON b.uuid = j.uuid AND b.model = j.model",
    )
    return ctes + [judged, repaired, res]


def lexical_ctes(threshold: float = 0.5) -> list[tuple[str, str]]:
    """Lexical judge ``lex(uuid, model, recall, precision)`` over ``samples``."""
    return [
        ("lgt", "SELECT DISTINCT uuid, gidx, token FROM "
                "(SELECT uuid, gidx, unnest(string_split_regex(lower(q), '\\s+')) AS token FROM gq)"),
        ("lrt", "SELECT DISTINCT uuid, model, ridx, token FROM "
                "(SELECT uuid, model, ridx, unnest(string_split_regex(lower(q), '\\s+')) AS token FROM rq)"),
        ("lgs", "SELECT uuid, gidx, count(*) AS sz FROM lgt GROUP BY ALL"),
        ("lrs", "SELECT uuid, model, ridx, count(*) AS sz FROM lrt GROUP BY ALL"),
        ("linter", "SELECT r.uuid, r.model, r.ridx, g.gidx, count(*) AS i "
                   "FROM lrt r JOIN lgt g ON g.uuid = r.uuid AND g.token = r.token GROUP BY ALL"),
        ("lmatch", "SELECT x.uuid, x.model, x.ridx, x.gidx FROM linter x "
                   "JOIN lgs g ON g.uuid = x.uuid AND g.gidx = x.gidx "
                   "JOIN lrs r ON r.uuid = x.uuid AND r.model = x.model AND r.ridx = x.ridx "
                   f"WHERE x.i = g.sz OR x.i = r.sz OR CAST(x.i AS DOUBLE) / (g.sz + r.sz - x.i) >= {threshold}"),
        ("lng", "SELECT uuid, count(*) AS ng FROM lgs GROUP BY uuid"),
        ("lnr", "SELECT uuid, model, count(*) AS nr FROM lrs GROUP BY ALL"),
        ("lhg", "SELECT uuid, model, count(DISTINCT gidx) AS hg FROM lmatch GROUP BY ALL"),
        ("lhr", "SELECT uuid, model, count(DISTINCT ridx) AS hr FROM lmatch GROUP BY ALL"),
        ("lex", "SELECT s.uuid, s.model, "
                "CASE WHEN coalesce(r.nr, 0) = 0 THEN (CASE WHEN coalesce(g.ng, 0) = 0 THEN 1.0 ELSE 0.0 END) "
                "WHEN coalesce(g.ng, 0) = 0 THEN 1.0 ELSE CAST(coalesce(hg.hg, 0) AS DOUBLE) / g.ng END AS recall, "
                "CASE WHEN coalesce(r.nr, 0) = 0 OR coalesce(g.ng, 0) = 0 THEN 0.0 "
                "ELSE CAST(coalesce(hr.hr, 0) AS DOUBLE) / r.nr END AS precision "
                "FROM samples s LEFT JOIN lng g ON g.uuid = s.uuid "
                "LEFT JOIN lnr r ON r.uuid = s.uuid AND r.model = s.model "
                "LEFT JOIN lhg hg ON hg.uuid = s.uuid AND hg.model = s.model "
                "LEFT JOIN lhr hr ON hr.uuid = s.uuid AND hr.model = s.model"),
    ]


def report_select(src: str, where: str = "") -> str:
    cols = ", ".join(
        f"{r4(f'avg(CASE WHEN {m} IS NOT NULL AND NOT isnan({m}) AND {m} > 0 THEN {m} ELSE 0.0 END)')} AS avg_{m}"
        for m in ("recall", "precision", "f1", "bm25", "format_score")
    )
    return f"SELECT model, {cols}, count(*) AS count FROM {src} {where} GROUP BY model"


def q(names, final: str, extra=None) -> str:
    return oracle_sql(names, final, extra)


SCORING_FX = ["fx_testset", "fx_inf", "fx_judgments"]
