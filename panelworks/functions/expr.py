"""Column expressions with one rule for missing values: inside the library only NULL is missing."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def clean_num(c: Column) -> Column:
    """A double; text that is no number, NaN and infinities become NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(c: Column, lo: float | Column, hi: float | Column) -> Column:
    """``c`` held between two bounds; NULL stays NULL."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.when(c.isNotNull(), F.greatest(lo, F.least(hi, c)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return F.try_divide(a, b)


def with_least(n: int, x: Column, w: WindowSpec, value: Column) -> Column:
    """``value`` where the frame holds at least ``n`` non-missing ``x``, else NULL."""
    return F.when(F.count(x).over(w) >= n, value)


def median3(a: Column, b: Column, c: Column) -> Column:
    """Median of a and the non-missing ones of b and c."""
    return F.when(b.isNull(), a).when(c.isNull(), (a + b) / 2).otherwise(F.sort_array(F.array(a, b, c))[1])


def pct_rank(x: Column, w: WindowSpec) -> Column:
    """Average rank of ``x`` over non-missing rows of the partition, divided by their number.

    ``w``: partition and order by ``x`` ascending, nulls last; ties share one sort.
    """
    n = F.count(x).over(w.rowsBetween(-(2**63), 2**63 - 1))
    ties = F.count(F.lit(1)).over(w.rangeBetween(0, 0))
    return F.when(x.isNotNull(), (F.rank().over(w) + (ties - 1) / 2) / n)


def rounded(c: Column, digits: int = 6) -> Column:
    """``c`` rounded, without negative zeros."""
    return F.round(c, digits) + F.lit(0.0)
