"""Arithmetic whose result does not depend on task order.

Sums of doubles differ in the last bits with the order in which partial sums
meet, so a retry or another partitioning could change a printed figure.  Values
are therefore added as whole millionths, and roundings use one stated formula.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c: Column | str, places: int) -> Column:
    """floor(x * 10^n + 0.5) / 10^n."""
    scale = float(10**places)
    return F.floor(col(c).cast("double") * scale + 0.5) / F.lit(scale)


def micro(c: Column | str) -> Column:
    """A double as whole millionths (null stays null)."""
    return F.round(col(c).cast("double") * float(MICRO)).cast("long")


def micro_sum(c: Column | str) -> Column:
    """Exact sum in millionths, 0 for an empty group."""
    return F.coalesce(F.sum(micro(c)), F.lit(0).cast("long"))


def from_micro(c: Column | str, places: int | None = None) -> Column:
    v = col(c) / F.lit(float(MICRO))
    return v if places is None else half_up(v, places)


def exact_avg(c: Column | str, places: int) -> Column:
    """Mean of a column, exact in the numerator, then rounded."""
    return half_up(F.sum(micro(c)) / F.count(col(c)) / F.lit(float(MICRO)), places)


def ratio(num: Column | str, den: Column | str, default: float | None = None) -> Column:
    """num / den, or `default` where the denominator is 0 or null."""
    r = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return r if default is None else F.coalesce(r, F.lit(float(default)))


def count_if(cond: Column) -> Column:
    """Rows where the condition holds; null counts as no."""
    return F.count(F.when(cond, F.lit(1)))


def least_of(*parts: Column | str) -> Column:
    """A sortable struct, for min_by / max_by with a full tie-break."""
    return F.struct(*[col(p) for p in parts])
