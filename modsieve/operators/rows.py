"""Row filters and list expansion that never evaluate expensive columns twice.

Spark pushes a filter below the projection that computes its input, and puts a "list is not empty"
filter below an explode; either way costly text expressions run once for the filter and once
more for the output.  An outer explode stays where it is, and a filter on its output cannot sink
below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_once(df: DataFrame, condition: Column) -> DataFrame:
    """``df.filter(condition)`` with everything below evaluated once per row."""
    marked = df.select("*", F.explode_outer(F.when(condition, F.array(F.lit(True)))).alias("_keep"))
    return marked.filter(F.col("_keep").isNotNull()).drop("_keep")


def expand(df: DataFrame, items: str, name: str, *keep: str) -> DataFrame:
    """``keep`` columns with one row per element of the list column ``items``; elements are not null."""
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def expand_with_position(df: DataFrame, items: str, position: str, name: str, *keep: str) -> DataFrame:
    wide = df.select(*keep, F.posexplode_outer(items).alias(position, name))
    return wide.filter(F.col(position).isNotNull())
