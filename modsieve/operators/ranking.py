"""Exact row numbers and running sums for groups of any size.

A window over a group sorts the group in one task.  With three labels over billions of rows, or
with one global order, that task never ends.  Here the rows are range-partitioned by group and order, with
borders that Spark draws from the values themselves, so outliers do not fill a partition and equal values may
be split.  One sum per group and partition gives each part its start, and windows sort inside a part only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modsieve.session import materialize


def hash_order(*columns: str, seed: int = 0) -> Column:
    """A repeatable pseudo-random order."""
    return F.xxhash64(*[F.col(c) for c in columns], F.lit(seed))


def scattered(key: Column, seed: int, modulus: int = 2_147_483_647) -> Column:
    """A repeatable scattered order from integer arithmetic, the same in every SQL engine."""
    return F.pmod(F.pmod(key, F.lit(modulus)) * F.lit(48_271) + F.lit(seed), F.lit(modulus))


def running_sum(df: DataFrame, order: str, weight: Column, groups: list[str] | None = None, tie: str | None = None,
                name: str = "running_sum") -> DataFrame:
    """Append the sum of ``weight`` up to and including the row, by ``order`` (then ``tie``) within ``groups``.

    Null orders come first, null groups are groups.  Rows equal in both are taken one after the other.  The rows
    are written once to the shared folder: keep ``df`` narrow and join wide columns back by key.
    """
    groups = groups or []
    sort = [F.col(c).asc_nulls_first() for c in [order, *([tie] if tie else [])]]
    tied = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).withColumn("_weight", weight)
    dealt = tied.repartitionByRange(*[F.col(g).asc_nulls_first() for g in groups], *sort, F.col("_tie"))
    parts = materialize(dealt.withColumn("_part", F.spark_partition_id()), "parts")
    sums = parts.groupBy(*groups, "_part").agg(F.sum("_weight").alias("_sum"))
    # one row per group and partition that holds it
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    renamed = [F.col(g).alias(f"_group_{k}") for k, g in enumerate(groups)]
    starts = sums.select(*renamed, F.col("_part").alias("_start_part"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*groups, "_part").orderBy(*sort, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parts.withColumn("_local", F.sum("_weight").over(inside))
    match = F.col("_part") == F.col("_start_part")
    for k, g in enumerate(groups):
        match = match & F.col(g).eqNullSafe(F.col(f"_group_{k}"))
    summed = local.join(starts, match).withColumn(name, F.col("_start") + F.col("_local"))
    return summed.select(*df.columns, name)


def ranked(df: DataFrame, order: str, groups: list[str] | None = None, tie: str | None = None, name: str = "row_number") -> DataFrame:
    """Append the exact 1-based row number by ``order`` (then ``tie``) within ``groups``; see :func:`running_sum`."""
    return running_sum(df, order, F.lit(1).cast("long"), groups, tie, name)
