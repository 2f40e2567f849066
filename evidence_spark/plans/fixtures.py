"""Fixture tables derived from the driver's Parquet tables.

Each fixture is one SQL body that Spark and DuckDB both run unchanged (only
``concat``/``||``, ``trim``, ``split_part``, ``replace``, ``lower``, ``CASE``, integer
``%`` and ``CAST``). The fixtures only shape rows into the schemas the operators expect
(corpus, inferences, judgments, ...); all the work a query names happens afterwards
in the library's operators.

Table placeholders ``{documents}``, ``{benchmark}``, ``{labels}``, ``{conversations}``
are bound to DataFrames by ``spark.sql(..., documents=df)`` and to the pre-registered
views by the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("documents", "benchmark", "labels", "conversations")


def _line(i: int) -> str:
    return f"split_part(text, chr(10), {i})"


def _block(expr: str) -> str:
    """B(x): '' when trim(x) is empty, else begin marker, trim(x), end marker."""
    return (
        f"CASE WHEN trim({expr}) = '' THEN '' "
        f"ELSE '##begin_quote## ' || trim({expr}) || ' ##end_quote## ' END"
    )


def _all_lines(expr: str) -> str:
    """Every line of x as a block of its own ('' when x is blank)."""
    return (
        f"CASE WHEN trim({expr}) = '' THEN '' ELSE '##begin_quote## ' || "
        f"replace({expr}, chr(10), ' ##end_quote## ##begin_quote## ') || ' ##end_quote## ' END"
    )


FIXTURES: dict[str, str] = {
    # corpus rows (S1 shape); golden quotes are all lines of the text, or (original_quotes)
    # its first line; doc_id kept for derived fixtures
    "fx_docs": f"""
SELECT doc_id,
       'd' || CAST(doc_id AS STRING) AS hf_id,
       trim({_line(1)}) AS question,
       text AS context,
       trim({_line(2)}) AS answer,
       CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS level,
       CASE WHEN doc_id % 25 = 0 THEN 'test'
            WHEN doc_id % 10 = 1 THEN 'validation'
            WHEN doc_id % 17 = 2 THEN 'holdout'
            WHEN doc_id % 19 = 3 THEN ''
            ELSE 'train' END AS split,
       {_block(_line(1))} AS original_quotes,
       CASE WHEN doc_id % 7 = 0 THEN CAST(NULL AS STRING)
            WHEN doc_id % 11 = 0 THEN ''
            ELSE {_all_lines("text")} END AS quotes
FROM {{documents}}""",
    # long inference table: one response per (uuid, model)
    "fx_inf": f"""
SELECT doc_id, hf_id AS uuid, 'm_exact' AS model, quotes FROM fx_docs WHERE quotes IS NOT NULL
UNION ALL
SELECT doc_id, hf_id AS uuid, 'm_first' AS model, original_quotes AS quotes FROM fx_docs
UNION ALL
SELECT d.doc_id, d.hf_id AS uuid, 'm.noise-1' AS model,
       ({_all_lines("d.context")}) || ({_block("b.text")}) AS quotes
FROM (SELECT *, doc_id % (SELECT count(*) FROM {{benchmark}}) AS slot FROM fx_docs) d
JOIN {{benchmark}} b ON b.item_id = d.slot
UNION ALL
SELECT d.doc_id, d.hf_id AS uuid, 'm_other' AS model, n.quotes AS quotes
FROM fx_docs d JOIN fx_docs n ON n.doc_id = d.doc_id + 1
UNION ALL
SELECT doc_id, hf_id AS uuid, 'm_badfmt' AS model, 'Answer: ' || quotes AS quotes
FROM fx_docs WHERE quotes IS NOT NULL
UNION ALL
SELECT doc_id, hf_id AS uuid, 'm_open' AS model, replace(quotes, '##end_quote##', '') AS quotes
FROM fx_docs WHERE quotes IS NOT NULL
UNION ALL
SELECT doc_id, hf_id AS uuid, 'm_empty' AS model, '' AS quotes FROM fx_docs""",
    # judge output stand-in for every pair
    "fx_all_judgments": """
SELECT doc_id, uuid, model,
       CAST(doc_id % 5 AS DOUBLE) / 4 AS recall,
       CASE WHEN doc_id % 13 = 0 THEN CAST(NULL AS DOUBLE)
            WHEN doc_id % 6 = 0 THEN CAST(0 AS DOUBLE)
            ELSE CAST(doc_id % 4 AS DOUBLE) / 4 END AS precision
FROM fx_inf""",
    # the same without pairs whose judge failed
    "fx_judgments": "SELECT * FROM fx_all_judgments WHERE doc_id % 23 <> 0",
    # a published dataset (S8 shape) with padded/lower-cased questions
    "fx_pool": """
SELECT doc_id, 's' || CAST(doc_id AS STRING) AS id, 'pool' AS source,
       '  ' || lower(question) || ' ' AS question, answer, context,
       original_quotes AS quotes,
       CASE WHEN doc_id % 8 = 0 THEN 'test' ELSE 'train' END AS split
FROM fx_docs""",
    # the part of it that is published already, so that the rest of the corpus is new
    "fx_existing": "SELECT * FROM fx_pool WHERE doc_id % 4 = 0",
    # manual score list; later ``ord`` wins, recall 2 is deliberately out of range
    "fx_manual": """
SELECT CAST(doc_id AS BIGINT) AS ord, 'd' || CAST(doc_id AS STRING) AS uuid,
       'm_first' AS model, CAST(quality AS DOUBLE) AS recall,
       CAST(1 - toxic AS DOUBLE) AS precision
FROM {labels}
UNION ALL
SELECT CAST(doc_id + 1000000 AS BIGINT) AS ord, 'd' || CAST(doc_id AS STRING) AS uuid,
       'm_first' AS model, CAST(2 AS DOUBLE) AS recall, CAST(0.5 AS DOUBLE) AS precision
FROM {labels} WHERE doc_id % 5 = 0""",
    # the test set the evaluation reads (uuid = corpus id)
    "fx_testset": """
SELECT doc_id, hf_id AS uuid, question, answer, context, quotes FROM fx_docs""",
    # scores stored by an earlier run: some real, some with every metric NULL
    "fx_prior_scores": """
SELECT uuid, model,
       CASE WHEN doc_id % 6 = 0 THEN recall END AS recall,
       CASE WHEN doc_id % 6 = 0 THEN precision END AS precision,
       CASE WHEN doc_id % 6 = 0 THEN CAST(0.5 AS DOUBLE) END AS f1,
       CASE WHEN doc_id % 6 = 0 THEN CAST(0.25 AS DOUBLE) END AS bm25,
       CASE WHEN doc_id % 6 = 0 THEN CAST(1 AS DOUBLE) END AS format_score
FROM fx_judgments WHERE doc_id % 3 = 0 AND model IN ('m_first', 'm_exact')""",
    # a published dataset with an optional uuid column (S9 input); some records stand twice
    "fx_published": """
SELECT doc_id, question, answer, context, quotes, split,
       CASE WHEN doc_id % 3 = 0 THEN 'd' || CAST(doc_id AS STRING)
            WHEN doc_id % 3 = 1 THEN '' END AS uuid
FROM fx_pool
UNION ALL
SELECT doc_id + 1000000 AS doc_id, question, answer, context, quotes, split,
       CASE WHEN doc_id % 3 = 0 THEN 'd' || CAST(doc_id AS STRING)
            WHEN doc_id % 3 = 1 THEN '' END AS uuid
FROM fx_pool WHERE doc_id % 5 = 0""",
    # inference files as a long table: file order, position in file; later wins.
    # File 2 overrides some m_first answers and names unknown uuids.
    "fx_inf_files": f"""
SELECT 'batch-1/' || model || '.json' AS file, doc_id AS pos, uuid, model, quotes FROM fx_inf
UNION ALL
SELECT 'batch-2/m_first.json' AS file, doc_id AS pos, hf_id AS uuid, 'm_first' AS model,
       {_block("split_part(context, chr(10), 3)")} AS quotes
FROM fx_docs WHERE doc_id % 9 = 0
UNION ALL
SELECT 'batch-2/m_first.json' AS file, doc_id + 100000000 AS pos, 'zz' || CAST(doc_id AS STRING) AS uuid,
       'm_first' AS model, 'unmatched' AS quotes
FROM fx_docs WHERE doc_id % 10 = 0""",
}

# dependency order for WITH clauses
ORDER = [
    "fx_docs",
    "fx_inf",
    "fx_all_judgments",
    "fx_judgments",
    "fx_pool",
    "fx_existing",
    "fx_manual",
    "fx_testset",
    "fx_prior_scores",
    "fx_published",
    "fx_inf_files",
]
DEPS = {
    "fx_docs": [],
    "fx_inf": ["fx_docs"],
    "fx_all_judgments": ["fx_inf"],
    "fx_judgments": ["fx_all_judgments"],
    "fx_pool": ["fx_docs"],
    "fx_existing": ["fx_pool"],
    "fx_manual": [],
    "fx_testset": ["fx_docs"],
    "fx_prior_scores": ["fx_judgments"],
    "fx_published": ["fx_pool"],
    "fx_inf_files": ["fx_inf", "fx_docs"],
}


def closure(names) -> list[str]:
    need: set[str] = set()

    def visit(n: str) -> None:
        if n not in need:
            need.add(n)
            for d in DEPS[n]:
                visit(d)

    for n in names:
        visit(n)
    return [n for n in ORDER if n in need]


def with_clause(names, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause defining the named fixtures (and their dependencies)."""
    parts = [f"{n} AS ({FIXTURES[n]}\n)" for n in closure(names)]
    parts += [f"{n} AS ({body}\n)" for n, body in (extra or [])]
    return "WITH " + ",\n".join(parts) if parts else ""


def driver_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in DRIVER_TABLES}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build one fixture table in Spark from the driver's tables."""
    sql = with_clause([name]) + f"\nSELECT * FROM {name}"
    used = {t: df for t, df in driver_tables(spark, sf_dir).items() if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def oracle_sql(names, final: str, extra: list[tuple[str, str]] | None = None) -> str:
    """DuckDB text: fixtures as CTEs over the pre-registered views, then ``final``."""
    text = with_clause(names, extra) + "\n" + final
    for t in DRIVER_TABLES:
        text = text.replace("{" + t + "}", t)
    return text
