"""Metric rules as column expressions: F1, precision repair, clamps, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, digits: int = 4) -> Column:
    """Round with ``floor(x * 10^d + 0.5) / 10^d`` (+0.0 removes a negative zero).

    Python's ``round`` differs only on exact decimal ties; this form gives the same
    double in every engine that follows IEEE arithmetic, which keeps results
    comparable across Spark and SQL checks.
    """
    scale = float(10**digits)
    c = _col(c)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale) + F.lit(0.0)


def clamp01(c) -> Column:
    """``max(0, min(1, x))`` with NULL preserved (``least(1, NULL)`` is 1 in Spark)."""
    c = _col(c)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))
    )


def clamp0_report(c) -> Column:
    """Report clamp: NULL -> 0, NaN -> 0, negative -> 0, no upper bound."""
    c = _col(c).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (c > 0), c).otherwise(F.lit(0.0))


def f1(precision, recall) -> Column:
    """F1 of clamped inputs; 0 when both are 0; NULL when an input is NULL."""
    p, r = clamp01(precision), clamp01(recall)
    total = p + r
    return F.when(p.isNull() | r.isNull(), F.lit(None).cast("double")).when(
        total == 0, F.lit(0.0)
    ).otherwise(F.lit(2.0) * (p * r) / F.when(total == 0, F.lit(1.0)).otherwise(total))


def repair_precision(recall, precision, n_gold, n_resp) -> Column:
    """A positive recall with zero precision implies at least one matched response.

    NULL recall/precision are read as 0 for the test; when it fires the precision
    becomes ``round(max(1/n_resp, recall*n_gold/n_resp), 4)`` (may exceed 1).
    Otherwise the stored precision (possibly NULL) is kept.
    """
    r0 = F.coalesce(_col(recall).cast("double"), F.lit(0.0))
    p0 = F.coalesce(_col(precision).cast("double"), F.lit(0.0))
    ng, nr = _col(n_gold), _col(n_resp)
    fires = (r0 > 0) & (p0 == 0) & (ng > 0) & (nr > 0)
    safe_nr = F.when(nr > 0, nr).otherwise(F.lit(1)).cast("double")
    repaired = round_half_up(F.greatest(F.lit(1.0) / safe_nr, r0 * ng / safe_nr), 4)
    return F.when(fires, repaired).otherwise(_col(precision).cast("double"))
