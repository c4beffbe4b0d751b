"""Top rows, grouped display order, percentiles and first appearances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of a total order; each task keeps n."""
    return df.orderBy(*order).limit(n)


def grouped_top(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows when groups stand in the order of their best row, with ``place`` from 1.

    No more than n groups can be among the first n rows, and none below the
    n-th best group; within a group no more than n rows count.  So each group
    is cut to n rows by a window on the group, and the groups to n by their best
    rows, before one short list is numbered.
    """
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__rank") <= n)
    best = ranked.filter(F.col("__rank") == 1).orderBy(*order).limit(n)
    numbered = best.select(F.col(group).alias("__group"), F.row_number().over(Window.orderBy(*order)).alias("__place"))
    short = ranked.join(F.broadcast(numbered), F.col(group).eqNullSafe(F.col("__group"))).orderBy("__place", "__rank").limit(n)
    return short.withColumn("place", F.row_number().over(Window.orderBy("__place", "__rank"))).drop("__rank", "__group", "__place")


def nearest_rank(df: DataFrame, wanted: dict[str, tuple[str, float, float]]) -> DataFrame:
    """One row of nearest-rank percentiles: name to (column, share, floor); zero rows give the floors."""
    return df.agg(*[F.greatest(F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{c}`)").cast("double"), F.lit(0.0)), F.lit(float(floor))).alias(name) for name, (c, p, floor) in wanted.items()])


def first_seen(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Distinct keys with the place where each was first."""
    return df.groupBy(*keys).agg(F.min(place).alias(place))
