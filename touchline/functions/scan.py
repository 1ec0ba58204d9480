"""Running totals that stay spread out when one key holds most of the rows.

`sum() over (partition by key order by ...)` sends a whole key to one task.
Here the key is cut along the leading order columns (a match by period and
minute): totals per cut are tiny and are accumulated first, then each cut is
scanned on its own and its base added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    coarse: Sequence[str],
    fine: Sequence[str],
    sums: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums over (coarse, fine) order within `keys`.

    `keys + coarse` must be non-null; (coarse, fine) must be a total order.
    """
    cut = [*keys, *coarse]
    vals = {n: F.coalesce(v.cast("long"), F.lit(0)) for n, v in sums.items()}
    per_cut = df.groupBy(*cut).agg(*[F.sum(v).alias(n) for n, v in vals.items()])
    w_cut = Window.partitionBy(*keys).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    base = per_cut.select(
        *cut, *[F.coalesce(F.sum(n).over(w_cut), F.lit(0)).alias(f"__base_{n}") for n in sums]
    )
    w_in = Window.partitionBy(*cut).orderBy(*fine).rowsBetween(Window.unboundedPreceding, 0)
    inner = df.select("*", *[F.sum(v).over(w_in).alias(f"__in_{n}") for n, v in vals.items()])
    out = inner.join(base, cut)
    return out.select(
        *df.columns, *[(F.col(f"__base_{n}") + F.col(f"__in_{n}")).alias(n) for n in sums]
    )
