"""Global row numbers without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modsieve.session import materialize


def starts(counts: DataFrame, part: str, size: str) -> DataFrame:
    """``part`` and ``start``, the sum of ``size`` over all earlier parts; ``counts`` has one row per task of a stage."""
    before = Window.partitionBy().orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(part, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias("start"))


def with_row_numbers(rows: DataFrame, keys: list[str], name: str = "row_number") -> DataFrame:
    """``rows`` (narrow) with gapless numbers from 0 in the order of ``keys``, and the table they were written to.

    The rows are range-partitioned and sorted by ``keys`` and written with their partition and place.  The partition
    counts, one row each, give every partition its first number.  A tie-breaker from the place of a row in its
    file lets the range partitioner split a key that holds many rows; rows alike in all ``keys`` are interchangeable.
    """
    tied = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col(k).asc_nulls_first() for k in keys]
    placed = tied.repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, "_tie").drop("_tie").select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    written = materialize(placed, "placed")
    first = materialize(starts(written.groupBy("_part").agg(F.count("*").alias("n")), "_part", "n"), "starts")
    return written.join(first, "_part").withColumn(name, F.col("start") + F.col("_place")).drop("_part", "_place", "start")
