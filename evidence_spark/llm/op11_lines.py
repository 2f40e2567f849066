"""Quality rules from cross-document line frequency (DataFrame functions only).

Lines are normalised (A-Z lower-cased, white space inside a line made one space, trimmed)
and hashed together with their host. The documents of a host that hold a line are counted;
lines in more than ``limit`` of them are removed, and a document is rejected when too few
of its words are left. Row-local rules (too few words, repeated five-word windows) come
with it.

The text is read once: statistics and the hashes of its lines are written as a narrow table.
Lines are counted with partial sums before the shuffle, so a line that stands in every
document costs one row per task. The lines above the limit are joined to the narrow table,
and the words they hold are summed for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import stored

#: A line in more documents of a host than this is removed.
LIMIT = 10
#: A document is depleted when fewer words are left, or a smaller share of them.
MIN_WORDS = 10
MIN_SHARE = 0.5
#: Words of a window, and the greatest percentage of words in repeated windows.
WINDOW = 5
MAX_REPEATED = 20

_WHITE = r"[\x20\x09-\x0D]+"
_INNER = r"[\x20\x09\x0B-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def _bind(value: Column, use) -> Column:
    """use(value), with the value computed once a row, also where use has lambdas of its own."""
    return F.transform(F.array(value), use)[0]


def normalised_lines(text: Column) -> Column:
    """The normalised lines of a text, blank ones as empty strings."""
    flat = F.regexp_replace(F.translate(text, _UPPER, _LOWER), _INNER, " ")
    return F.transform(F.split(flat, "\n"), lambda x: F.trim(x))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _WHITE), "")


def line_words(line: Column) -> Column:
    """Words of a normalised line."""
    return F.when(line == "", 0).otherwise(F.regexp_count(line, F.lit(" ")) + 1)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words found twice or more (all places counted).

    Windows are compared by 64-bit hashes. A text whose windows all differ is done when
    they are counted; else they are sorted with their places, equal neighbours are kept,
    and their places are walked in order.
    """
    def places(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        # a negative index of get gives null, so the first window has no left neighbour
        return _bind(ordered, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])), lambda x: x["p"])))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + F.lit(k)) for k in range(width)]))

    found = _bind(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _bind(places(h), covered)).otherwise(0))
    return F.when(F.size(words) <= width, 0).otherwise(found).cast("long")


def statistics(text: Column) -> dict[str, Column]:
    """Row-local statistics of a text that is not null."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return {
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def line_table(docs: DataFrame, keep: list[str], text_col: str, host_col: str, with_text: bool = False) -> DataFrame:
    """Written table: row, kept columns, statistics, and (hash, words) of every line.

    ``row`` numbers the rows; it is fixed because the table is written before it is used.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    host = F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit(""))
    src = docs.select(*[F.col(c).alias(f"_{c}") for c in keep], text.alias("text"), host.alias("host"))
    lines = F.transform(normalised_lines(F.col("text")), lambda x: F.struct(
        F.when(x != "", F.xxhash64(F.col("host"), x)).alias("h"), line_words(x).alias("w")))
    stats = [c.alias(n) for n, c in statistics(F.col("text")).items()]
    out = src.select(
        F.monotonically_increasing_id().alias("row"), *[f"_{c}" for c in keep], *(["text"] if with_text else []), *stats,
        _bind(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("ws"), lines.alias("lines"))
    return stored(out, "document-lines")


def frequent_lines(lines: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(h, n): lines of a host that more than ``limit`` of its documents hold; each row is a document."""
    hashes = F.array_distinct(F.transform(F.filter("lines", lambda x: x["h"].isNotNull()), lambda x: x["h"]))
    held = lines.select(F.explode(hashes).alias("h"))
    return held.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)


def _verdicts(lines: DataFrame, limit: int, min_words: int, min_share: float, places: bool) -> DataFrame:
    """``lines`` without its arrays, with what is removed of each row and whether it is kept."""
    flat = lines.select("row", F.posexplode("lines").alias("place", "line")).select("row", "place", "line.h", "line.w").where("h IS NOT NULL")
    flat = flat if places else flat.drop("place")
    gone = flat.join(frequent_lines(lines, limit).select("h"), "h").groupBy("row").agg(
        F.sum("w").alias("removed_words"), F.count(F.lit(1)).alias("removed_lines"), *([F.collect_set("place").alias("places")] if places else []))
    n, repeat, left = F.col("n_words"), F.col("n_repeat_words"), F.col("n_words") - F.col("removed_words")
    failed = (n < 10) | (100 * repeat > MAX_REPEATED * n)
    depleted = (left < min_words) | (left < min_share * n)
    out = lines.drop("lines").select("*", F.col("ws.n").alias("n_words"), F.col("ws.r").alias("n_repeat_words")).drop("ws").join(gone, "row", "left")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long"))).withColumn("removed_lines", F.coalesce("removed_lines", F.lit(0).cast("long")))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def judge_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = LIMIT,
                min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per row of ``docs``: its statistics, what is removed, ``base_failed`` and ``kept``.

    A null text counts as empty, a null host as a host of its own, a null id stays null.
    Every row is a document: repeated rows count each, and get equal results. Lines
    without a word are never counted or removed. A line that stands several times in a
    document counts one document, and all its places are removed. An empty table gives
    an empty result; other columns are ignored. The texts of a row stay within its task.
    """
    lines = line_table(docs, [id_col], text_col, host_col)
    return _verdicts(lines, limit, min_words, min_share, False).select(
        F.col(f"_{id_col}").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "removed_lines", "removed_words")


def clean_documents(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", limit: int = LIMIT,
                    min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, the frequent lines taken out of the text.

    Nulls, repeated rows and empty tables as in :func:`judge_lines`; the other lines of a
    text stay as they are.
    """
    lines = line_table(docs, docs.columns, text_col, host_col, with_text=True)
    kept = _verdicts(lines, limit, min_words, min_share, True).where("kept")
    whole = F.split("text", "\n")
    left = F.array_join(F.filter(whole, lambda x, i: ~F.array_contains("places", i)), "\n")
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(left)
    return kept.select(*[(text if c == text_col else F.col(f"_{c}")).alias(c) for c in docs.columns])


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('h' || source, '') AS host FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
raw AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d),
norm AS (
  SELECT r, host, line, trim(regexp_replace(translate(line, '{_UPPER}', '{_LOWER}'), '{_INNER}', ' ', 'g'), ' ') AS x FROM raw),
dup AS (SELECT r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM norm WHERE x <> '' GROUP BY r),
often AS (SELECT host, x FROM norm WHERE x <> '' GROUP BY host, x HAVING count(DISTINCT r) > {LIMIT}),
gone AS (
  SELECT r, CAST(count(*) AS BIGINT) AS removed_lines, CAST(sum(len(string_split(x, ' '))) AS BIGINT) AS removed_words
  FROM norm JOIN often USING (host, x) GROUP BY r),
places AS (SELECT r, words, unnest(range(1, len(words) - {WINDOW} + 2)) AS p FROM w WHERE len(words) >= {WINDOW}),
grams AS (SELECT r, p, words[p:p + {WINDOW} - 1] AS g FROM places),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
rep AS (
  SELECT r, CAST(sum(least({WINDOW}, coalesce(nxt - p, {WINDOW}))) AS BIGINT) AS n_repeat_words
  FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM twice) GROUP BY r),
base AS (
  SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(removed_lines, 0) AS removed_lines, coalesce(removed_words, 0) AS removed_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= {MIN_WORDS} AND n_words - removed_words >= {MIN_SHARE} * n_words AS kept,
       removed_lines, removed_words
FROM judged
"""
