"""Carry all columns of a table past an operator's own, whatever they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_of_each(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """One physical row of ``rows`` for every row of ``keys``; ``rows`` has the columns ``_id`` and ``_digest`` beside its own,
    ``keys`` these two and ``n``, how many rows have them.

    Keys of one row are a semi-join, by sort and merge: there is one for nearly every row, too many to broadcast.  Where several rows share a key, an aggregate combined before the shuffle picks one,
    so the copies of a hot key never meet; without such keys that pass is left out.
    """
    def of(some: DataFrame) -> DataFrame:
        named = some.select(F.col("_id").alias("_i"), F.col("_digest").alias("_d"))
        return rows.join(named, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_digest") == F.col("_d")), "left_semi")

    single, repeated = of(keys.filter("n = 1").hint("merge")), keys.filter("n > 1")
    if repeated.isEmpty():
        return single
    picked = of(repeated).groupBy("_id", "_digest").agg(F.first(F.struct(*rows.columns)).alias("_first"))
    return single.unionByName(picked.select("_first.*"))


class Carried:
    """A table under working names; :meth:`restore` gives its columns their names back.

    Results replace columns of the same name (in any case); working columns of an operator clash with none.
    """

    def __init__(self, table: DataFrame):
        self.names = table.columns
        self.frame = table.toDF(*[f"c{k}" for k in range(len(self.names))])

    def __getitem__(self, name: str) -> Column:
        return F.col(f"c{self.names.index(name)}")

    def restore(self, frame: DataFrame, results: list[str]) -> DataFrame:
        taken = {r.lower() for r in results}
        kept = [F.col(f"c{k}").alias(name) for k, name in enumerate(self.names) if name.lower() not in taken]
        return frame.select(*kept, *results)
