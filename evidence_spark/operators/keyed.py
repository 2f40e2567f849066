"""Keyed-table operations on plain DataFrames: last-wins, upsert, key checks.

Parquet has no MERGE; an upsert is ``target LEFT ANTI updates`` unioned with the
updates, written as a new snapshot. Last-wins chooses among narrow (key, order) rows,
counted map-side: a hot key never drags all its rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.session import scratch_path

#: Narrow rows that a broadcast may hold.
FEW = 200_000


def last_wins(df: DataFrame, keys: list[str], order: list[str | Column], unique: bool = False,
              among: DataFrame | None = None) -> DataFrame:
    """One row per key: the row with the greatest ``struct(order)``.

    NULL values of the winning row are kept (a later NULL overrides an earlier value).

    The winning (key, order) is found on narrow rows, and whole rows are joined to it, so
    texts are moved once and never sorted by an aggregation. Rows of a key that tie at the
    greatest order are reduced to one of them by a hash of their values, in a branch of
    its own that reads the rows again; with ``unique`` the caller states that no two rows
    of a key have the same order, and there is no such branch. With ``among`` only keys whose
    values of its columns (some of ``keys``) stand in it: the narrow winners are tested, so the
    test moves no text.
    """
    values = [c for c in df.columns if c not in keys]
    ordering = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
    names = [f"_o{i}" for i in range(len(order))]
    # one row per (key, order) first: a hot key is counted before its rows meet
    counted = df.select(*keys, *ordering).groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    top = F.max(F.struct(*names, "_n")).alias("_w")
    if among is not None:
        counted = counted.join(among, among.columns, "left_semi")
    winner = counted.groupBy(*keys).agg(top).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_w._n").alias("_n"),
                                                   *[F.col(f"_w.{n}").alias(f"_w{n}") for n in names])
    rows = df.select("*", *ordering)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(n).eqNullSafe(F.col(f"_w{n}")) for n in names]

    def whole(winners: DataFrame) -> DataFrame:
        cond = same[0]
        for c in same[1:]:
            cond = cond & c
        return rows.join(winners, cond).select(*df.columns)

    if unique:
        return whole(winner).select(*keys, *values)
    tied = whole(winner.where("_n > 1")).groupBy(*keys).agg(F.max_by(F.struct(*values), F.xxhash64(*values)).alias("_winner"))
    return whole(winner.where("_n = 1")).select(*keys, *values).unionByName(tied.select(*keys, "_winner.*"))


def few(stored: DataFrame, rows: int = FEW) -> DataFrame | None:
    """A stored narrow table for the small side of a join: None if it is empty, marked for
    broadcast if it has at most ``rows`` rows (counted), else left to a shuffle join."""
    n = stored.count()
    return None if n == 0 else F.broadcast(stored) if n <= rows else stored


def without_earlier(df: DataFrame, keys: list[str], order: list[str], unique: bool = True, rows: int = FEW) -> DataFrame:
    """:func:`last_wins` for rows that are mostly the last of their key, no two of a key having the same order (``unique``).

    The rows that a later one of their key overrides are found among narrow rows and stored when
    this is called. Where they are few, the others are kept without a shuffle. Where they are
    many, only the rows that share the first columns of ``order`` (all but the last, such as a file)
    with one of them are shuffled. ``df`` must be a table whose rows stay as they are.
    """
    if not unique:
        raise ValueError("rows of a key must differ in their order")
    part = order[:-1] or order
    narrow = df.select(*keys, *order)
    last = narrow.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    last = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_last")

    def equal(names: list[str], prefix: str) -> Column:
        cond = F.lit(True)
        for i, name in enumerate(names):
            cond = cond & F.col(name).eqNullSafe(F.col(f"{prefix}{i}"))
        return cond

    earlier = narrow.join(last, equal(keys, "_k")).where(~F.struct(*order).eqNullSafe(F.col("_last")))
    path = scratch_path(df.sparkSession, "earlier-rows")
    names = [*keys, *order]
    earlier = earlier.select(*[F.col(c).alias(f"_e{i}") for i, c in enumerate(names)])
    earlier.write.parquet(path)
    earlier = df.sparkSession.read.schema(earlier.schema).parquet(path)
    lost = few(earlier, rows)
    if lost is None:
        return df
    if lost is not earlier:
        return df.join(lost, equal(names, "_e"), "left_anti")
    parts = earlier.select(*[F.col(f"_e{names.index(c)}").alias(f"_p{i}") for i, c in enumerate(part)]).distinct()
    if parts.count() > rows:
        return df.join(earlier, equal(names, "_e"), "left_anti")
    parts = F.broadcast(parts)
    touched, whole = (df.join(parts, equal(part, "_p"), how) for how in ("left_semi", "left_anti"))
    return whole.unionByName(touched.join(earlier, equal(names, "_e"), "left_anti"))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], allow_missing: bool = True) -> DataFrame:
    """Replace whole target rows whose key appears in ``updates``; add new keys.

    ``updates`` must be unique on ``keys`` (use :func:`last_wins` first).
    """
    kept = target.join(updates.select(*keys), keys, "left_anti")
    return kept.unionByName(updates, allowMissingColumns=allow_missing)


def duplicate_keys(batch: DataFrame, keys: list[str]) -> DataFrame:
    """S7 within a batch: keys that occur more than once, with their count."""
    return batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def conflicting_keys(batch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """S7 against a table: batch keys already present in the target."""
    return batch.select(*keys).distinct().join(target.select(*keys), keys, "left_semi")


def key_violations(batch: DataFrame, target: DataFrame | None, keys: list[str]) -> DataFrame:
    """All key violations as (keys..., reason): 'duplicate_in_batch' / 'exists_in_target'."""
    dup = duplicate_keys(batch, keys).select(*keys, F.lit("duplicate_in_batch").alias("reason"))
    if target is None:
        return dup
    clash = conflicting_keys(batch, target, keys).select(*keys, F.lit("exists_in_target").alias("reason"))
    return dup.unionByName(clash)


def update_field(table: DataFrame, changes: DataFrame, key: str, field: str) -> DataFrame:
    """Set ``field`` from ``changes(key, value)``; adds ``changed`` (value differs).

    Keys absent from the table are ignored, as an update of a missing record.
    ``changes`` must be unique on ``key``.
    """
    ch = changes.select(F.col(key), F.col("value").alias("_new"), F.lit(True).alias("_matched"))
    joined = table.join(ch, key, "left")
    matched = F.coalesce(F.col("_matched"), F.lit(False))
    new_value = F.when(matched, F.col("_new")).otherwise(F.col(field))
    changed = matched & ~F.col(field).eqNullSafe(F.col("_new"))
    return joined.withColumn("changed", changed).withColumn(field, new_value).drop("_new", "_matched")
