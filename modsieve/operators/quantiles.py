"""Exact linear-interpolated quantiles without holding all values in one place.

A sketch brackets every wanted rank, exact counts below and inside the bracket turn the rank into
a position inside it, and only the few values in the brackets are ordered, in as many tasks as they need.  Two passes in all: one
for sketch and moments, one for value counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modsieve.operators.ranking import running_sum

ACCURACY = 10_000
MOMENTS = ["count", "mean", "std", "min", "max"]


def describe(df: DataFrame, column: str, probs: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """One row: count, mean, sample std, min, max and one column per name in ``probs``.

    The quantile at ``p`` lies between the values at ranks ``floor`` and ``ceil`` of ``p*(n-1)``;
    the answer is the same as sorting everything.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    slack = 2.0 / accuracy
    low = [max(p - slack, 0.0) for p in probs.values()]
    high = [min(p + slack, 1.0) for p in probs.values()]
    sketch = values.agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
        F.percentile_approx("v", F.array(*[F.lit(p) for p in low]), accuracy).alias("lo"),
        F.percentile_approx("v", F.array(*[F.lit(p) for p in high]), accuracy).alias("hi"),
    ).select(F.struct("*")).scalar()

    # Every distinct value is tagged with the brackets it is not above.
    counts = values.groupBy("v").agg(F.count("*").alias("c")).withColumn("s", sketch)
    s = F.col("s")
    tagged = counts.select("v", "c", "s", F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("name"), (F.lit(float(p)) * (s["count"] - 1)).alias("at"),
            # up to `accuracy` values a sketch holds them all, and a bracket of two ranks either way could miss
            # the rank it is for by rounding: the whole range is the bracket then, at most `accuracy` values
            F.when((s["count"] <= accuracy) | F.lit(low[i] == 0.0), s["min"]).otherwise(s["lo"][i]).alias("lo"),
            F.when((s["count"] <= accuracy) | F.lit(high[i] == 1.0), s["max"]).otherwise(s["hi"][i]).alias("hi"),
        ) for i, (name, p) in enumerate(probs.items())
    ])).alias("q")).select("v", "c", "s", "q.*").filter(F.col("v") <= F.col("hi"))
    # Values below a bracket collapse into one row per quantile before the window sorts anything.
    squeezed = (
        tagged.withColumn("v", F.when(F.col("v") < F.col("lo"), F.lit(float("-inf"))).otherwise(F.col("v")))
        .groupBy("name", "v").agg(F.sum("c").alias("c"), F.max("at").alias("at"), F.any_value("s").alias("s"))
    )
    upto = running_sum(squeezed, "v", F.col("c"), ["name"], name="upto")
    placed = upto.withColumn("last", F.col("upto") - 1).withColumn("first", F.col("last") - F.col("c") + 1)
    below, above = F.floor("at"), F.ceil("at")
    picked = placed.groupBy("name").agg(
        F.max(F.when((F.col("first") <= below) & (below <= F.col("last")), F.col("v"))).alias("a"),
        F.max(F.when((F.col("first") <= above) & (above <= F.col("last")), F.col("v"))).alias("b"),
        F.max(F.col("at") - below).alias("w"), F.any_value("s").alias("s"),
    ).select("name", (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("value"), "s")
    row = picked.agg(F.any_value("s").alias("s"),
                     *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in probs])
    return row.select(
        F.coalesce(F.col("s")["count"], F.lit(0)).alias("count"),
        *[F.col("s")[name].alias(name) for name in MOMENTS[1:]], *probs)


def exact_quantiles(df: DataFrame, column: str, probs: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """One row, one column per name in ``probs``."""
    return describe(df, column, probs, accuracy).select(*probs)
