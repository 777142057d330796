"""Global row numbers and running sums in two levels, without a window over one partition.

Rows are sorted into range partitions and written once to the shared folder, so that ties and range
bounds stay as they are when a task is run again. Only one row a partition is then summed up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.naming import free
from millrace.plans.storage import scratch, stored  # noqa: F401  given on


def numbered(df: DataFrame, order: list, name: str = "_i") -> DataFrame:
    """Rows with their place in the order, from 1. Equal keys are numbered in any, but a fixed, order."""
    part, place, base = free([*df.columns, name], "__part", "__place", "__base")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = stored(df.orderBy(*order).withColumns({part: F.spark_partition_id(), place: at}), "numbered")
    sizes = held.groupBy(part).count()
    starts = sizes.select(part, (F.sum("count").over(Window.orderBy(part)) - F.col("count")).alias(base))
    return held.join(F.broadcast(starts), part).select(*df.columns, (F.col(base) + F.col(place) + 1).alias(name))  # one row a partition


def numbered_within(df: DataFrame, by: str, order: list, name: str = "_i") -> DataFrame:
    """Places from 1 within each value of ``by``, missing ones included; a frequent value takes many tasks."""
    rows = numbered(df, [by, *order], name)
    value, base = free([*df.columns, name], "__value", "__base")
    firsts = rows.groupBy(F.col(by).alias(value)).agg(F.min(name).alias(base))
    return rows.join(firsts, F.col(by).eqNullSafe(F.col(value))).select(*df.columns, (F.col(name) - F.col(base) + 1).alias(name))


def running(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """``sums[new] = column``: sums of all rows up to each, in an order whose keys are distinct."""
    part, *bases = free([*df.columns, *sums], "__part", *[f"__base{i}" for i in range(len(sums))])
    held = stored(df.orderBy(*order).withColumn(part, F.spark_partition_id()), "running")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(part).agg(*[F.sum(c).alias(b) for b, c in zip(bases, sums.values())])
    starts = totals.select(part, *[F.coalesce(F.sum(b).over(before), F.lit(0)).alias(b) for b in bases])
    inside = Window.partitionBy(part).orderBy(*order)
    rows = held.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(starts), part)
    return rows.select(*df.columns, *[(F.col(n) + F.col(b)).alias(n) for n, b in zip(sums, bases)])
