"""Bounded, repeatable samples of labelled posts for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modsieve.session import materialize


def labelled_sample(posts: DataFrame, label: str, rows_per_label: int, key: str = "content") -> DataFrame:
    """About ``rows_per_label`` rows of each non-null ``label``, whole rows, no two of one label with the same non-null ``key``.

    A key is drawn if a hash of it is below the share that its label allows; the share counts different keys, so rows that repeat one,
    however many, neither fill the sample nor keep others out.  Every run draws the same keys.  Labels with fewer keys are
    taken whole.  Keys are hashed before anything is shuffled; of the rows, only drawn ones meet, to leave one of each.
    """
    known = posts.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).withColumn("_digest", F.xxhash64(F.col(key), F.lit("sample")))
    counts = materialize(known.select(label, "_digest").distinct().groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_keys")), "label_sizes")
    draw = F.xxhash64("_digest").bitwiseAND((1 << 53) - 1).cast("double") / F.lit(float(1 << 53))
    drawn = known.join(counts, F.col(label) == F.col("_label")).filter(draw * F.col("_keys") < rows_per_label)
    return drawn.dropDuplicates([label, "_digest"]).select(posts.columns)
