"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Every row gets a uniform number from a hash of the seed and its own id and text. Inverting
the Poisson distribution function whose mean is the source's repetition rate turns that
number into a copy count, so the decision needs no state, no join and no second look at
the row, and is the same after a lost executor. Copies are then shuffled globally by the
hash of (row, copy).

The rate of a listed source is ``weight / sum of weights * rows wanted / rows it has``; a
source that is not listed, or null, keeps ``other_rate`` (1: as often as it occurs, on
average). The only thing brought to the driver is one count for each *listed* source.

A Poisson number of mean r is the sum of m independent ones of mean r / m. A rate above
``PART_RATE`` is therefore split into equal parts: the row is exploded into its parts, each
with a hash and an inversion of its own, the parts are spread over the tasks, and only
there exploded into copies. So no table in the plan is longer than that of ``PART_RATE``,
and no task makes more than a few hundred copies of one row in one go.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the mixture wanted from each source of the corpus (the production setting).
TARGETS = {"src0": 0.10, **{f"src{i}": 0.90 / 19 for i in range(1, 20)}}
SEED = "mix-1"
#: Largest mean that one number inverts.
PART_RATE = 64
#: Terms beyond the mean that are less likely than this are left out.
TAIL = 1e-17


def poisson_cdf(rate: float) -> list[float]:
    """Distribution function of Poisson(rate) at 0, 1, 2, ... until it no longer grows."""
    if rate <= 0:
        return []
    out, total, k = [], 0.0, 0
    while True:
        p = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        total += p
        if k > rate and p < TAIL:
            return out
        out.append(total)
        k += 1


def parts_of(rate: float) -> int:
    """Number of equal parts that a rate is split into."""
    return max(1, math.ceil(rate / PART_RATE))


def uniform(key: Column) -> Column:
    """Number in [0, 1) from the first 52 bits of an md5 in hex."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, targets: dict[str, float], rows: int | None, source: str = "source") -> dict[str, float]:
    """Mean repetition rate of each listed source that has rows.

    One count per listed source reaches the driver: its size is bound by the parameter.
    """
    wanted = {k: float(w) for k, w in targets.items() if w > 0}
    counts = {r[0]: r[1] for r in docs.where(F.col(source).isin(sorted(targets))).groupBy(source).count().collect()}
    have = {k: counts[k] for k in sorted(wanted) if counts.get(k)}
    total = sum(counts.values()) if rows is None else rows
    weights = sum(wanted[k] for k in have)
    rates = {k: 0.0 for k in targets}
    rates.update({k: wanted[k] / weights * total / n for k, n in have.items()})
    return rates


def poisson_mix(docs: DataFrame, targets: dict[str, float] | None = None, *, rows: int | None = None,
                other_rate: float = 1.0, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", copy_col: str = "mix_copy", key_col: str = "mix_key") -> DataFrame:
    """All columns of ``docs`` plus ``copy_col`` (long) and ``key_col`` (place in the shuffle).

    Copies of a row are numbered 0, 1, ...; where the rate is split into m parts, copy k of
    part p has the number ``p + m k``, so numbers are distinct but leave gaps. Null ids and
    texts count as empty text; equal rows get equal counts; an empty table gives an empty
    result; input columns named like the two new ones are replaced.
    """
    targets = TARGETS if targets is None else targets
    docs = docs.drop(copy_col, key_col)
    rates = source_rates(docs, targets, rows, source_col)

    def by_source(value) -> Column:
        """value(rate) of the row's source."""
        other = value(other_rate)
        if not rates:
            return other
        table = F.create_map(*[x for k, r in sorted(rates.items()) for x in (F.lit(k), value(r))])
        return F.when(F.col(source_col).isin(sorted(rates)), F.element_at(table, F.coalesce(F.col(source_col), F.lit("")))).otherwise(other)

    row_key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                                F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))
    keyed = docs.withColumn(key_col, row_key)
    cdf = by_source(lambda r: F.array(*[F.lit(x) for x in poisson_cdf(r / parts_of(r))]).cast("array<double>"))
    parts = by_source(lambda r: F.lit(parts_of(r)).cast("long"))

    def count(key: Column) -> Column:
        # a one-element array binds the number once, for the lambda to reuse
        return F.transform(F.array(uniform(key)), lambda u: F.size(F.filter(cdf, lambda x: x <= u)))[0].cast("long")

    def numbers(n: Column, number) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), number))

    split = any(parts_of(r) > 1 for r in (other_rate, *rates.values()))
    out = keyed.where(parts == 1) if split else keyed
    out = out.withColumn(copy_col, count(F.col(key_col))).where(F.col(copy_col) > 0)
    out = out.withColumn(copy_col, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copy_col) - 1)))
    if split:
        many = keyed.where(parts > 1).withColumn(copy_col, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        many = many.repartition(F.col(key_col), F.col(copy_col))
        part_key = F.md5(F.concat_ws("/", F.col(key_col), F.col(copy_col).cast("string")).cast("binary"))
        many = many.withColumn(copy_col, F.explode(numbers(count(part_key), lambda k: F.col(copy_col) + parts * k)))
        out = out.unionByName(many)
    out = out.withColumn(key_col, F.md5(F.concat_ws("#", F.col(key_col), F.col(copy_col).cast("string")).cast("binary")))
    return out.repartition(F.col(key_col)).sortWithinPartitions(key_col)


def oracle(targets: dict[str, float] | None = None, seed: str = SEED, other_rate: float = 1.0) -> str:
    """The same rows in DuckDB SQL over the table ``documents``."""
    targets = TARGETS if targets is None else targets
    rows = ", ".join(f"('{k}', CAST({w!r} AS DOUBLE))" for k, w in sorted(targets.items()))
    return f"""
WITH targets(source, weight) AS (VALUES {rows}),
counts AS (SELECT source, count(*) AS n FROM documents WHERE source IN (SELECT source FROM targets) GROUP BY source),
have AS (SELECT source, weight, n FROM targets JOIN counts USING (source) WHERE weight > 0),
rates AS (
  SELECT t.source, CASE WHEN h.n IS NULL THEN 0.0 ELSE h.weight / (SELECT sum(weight ORDER BY source) FROM have)
         * (SELECT sum(n) FROM counts) / h.n END AS rate
  FROM targets t LEFT JOIN have h USING (source)
  UNION ALL SELECT NULL, CAST({other_rate!r} AS DOUBLE)),
parts AS (SELECT source, greatest(1, CAST(ceil(rate / {PART_RATE}) AS BIGINT)) AS m,
                 rate / greatest(1, CAST(ceil(rate / {PART_RATE}) AS BIGINT)) AS rate FROM rates),
terms AS (SELECT source, k, rate, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
          FROM (SELECT * FROM parts WHERE rate > 0), range(0, {4 * PART_RATE}) r(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS f FROM terms WHERE k <= rate OR p >= {TAIL!r}),
rowkeys AS (
  SELECT *, md5(concat_ws('|', '{seed}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS rk,
         CASE WHEN source IN (SELECT source FROM targets) THEN source END AS rs FROM documents),
pieces AS (
  SELECT *, CASE WHEN m > 1 THEN md5(rk || '/' || CAST(part AS VARCHAR)) ELSE rk END AS pk FROM (
    SELECT r.*, t.m, unnest(range(0, t.m)) AS part FROM rowkeys r JOIN parts t ON t.source IS NOT DISTINCT FROM r.rs)),
counted AS (
  SELECT r.*, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM r.rs
               AND c.f <= CAST('0x' || substr(r.pk, 1, 13) AS BIGINT) / 4503599627370496.0) AS copies
  FROM pieces r)
SELECT doc_id, text, lang, source, n_chars, c AS mix_copy, md5(rk || '#' || CAST(c AS VARCHAR)) AS mix_key
FROM (SELECT *, part + m * unnest(range(0, copies)) AS c FROM counted WHERE copies > 0)
"""
