"""Mix labelled or sourced posts to target weights by repeating and dropping whole posts.

Edge cases: a null category is a category of its own, last in order; a null or empty content has size 0 and
may be emitted any number of times without counting; rows are mixed one by one, each with a draw of its own, also where
they repeat an id or have none: in such a table the draws come from the id, the content and the place of the row in its files;
a category whose sizes sum to 0 has target 0 and emits nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modsieve.llm.carry import Carried
from modsieve.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def unit_draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) with 52 bits, fixed by the key and the seed alone; the same in any engine with MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def category_targets(posts: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Per category: ``category``, ``category_size`` and ``target``.

    Categories in code point order, null last, take the ``weights`` in turn.  Together they get ``share`` times
    all sizes, by weight; none gets more than ``most`` times its own size, and what it cannot take goes to the
    others by weight.  The final state is a water level: with categories in the order of size per weight, those
    below the level take ``most`` times their size, the others share the rest by weight.  Sizes are summed
    before anything meets in one task, which then sees one row per category.
    """
    sizes = posts.groupBy("category").agg(F.sum("size").alias("category_size"))
    every = Window.partitionBy()
    by_name = Window.partitionBy().orderBy(F.col("category").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    by_level = Window.partitionBy().orderBy(F.col("category_size") / F.col("weight"), F.col("category").asc_nulls_last())
    lighter = by_level.rowsBetween(Window.unboundedPreceding, -1)
    measured = weighted.select(
        "category", "category_size", "weight",
        (F.sum("category_size").over(every) * F.lit(share)).alias("_all"),
        F.sum("weight").over(every).alias("_weights"),
        F.coalesce(F.sum("category_size").over(lighter), F.lit(0)).alias("_below"),
        F.coalesce(F.sum("weight").over(lighter), F.lit(0)).alias("_lighter"),
        F.row_number().over(by_level).alias("_place"),
    )
    cap = F.col("category_size") * F.lit(most)
    rest, heavy = F.col("_all") - F.col("_below") * F.lit(most), F.col("_weights") - F.col("_lighter")
    full = rest * F.col("weight") >= cap * heavy
    level = measured.withColumn("_full", full).withColumn("_level", F.min(F.when(~full, F.struct(
        F.col("_place").alias("place"), rest.alias("rest"), heavy.alias("heavy")))).over(every))
    target = F.when(F.col("_full"), cap).otherwise(F.col("_level")["rest"] * F.col("weight") / F.col("_level")["heavy"])
    return level.select("category", "category_size", target.cast("double").alias("target"))


def copies_of(posts: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """``posts`` (``post_id``, ``category``, ``content``) with ``size``, ``category_size``, ``target`` and ``copies``.

    ``size`` counts the words of the content.  The repetition rate of a category is its target over its size.  Every
    post is taken ``floor(rate)`` times, and once more if its draw, a hash of the seed and its id, is below the
    fraction that is left.  In a table with repeated or null ids the draws are of rows, not of ids, and reruns over the same files agree.  The category sizes are summed first and the
    targets, one row per category, are written; Spark then knows their size and broadcasts them if they are small,
    so the contents are not shuffled.
    """
    carried = Carried(posts)
    counted = _counted(carried, weights, share, most, seed)
    return carried.restore(counted, ["size", "category_size", "target", "copies"])


def _counted(carried: Carried, weights: list[int], share: float, most: float, seed: str) -> DataFrame:
    content = F.coalesce(carried["content"].cast("string"), F.lit(""))
    sized = carried.frame.withColumn("size", F.size(F.regexp_extract_all(content, F.lit(WORD), F.lit(0))).cast("long"))
    category = carried["category"].cast("string")
    targets = materialize(category_targets(sized.select(category.alias("category"), "size"), list(weights), share, most), "targets")
    rate = F.when(F.col("category_size") > 0, F.col("target") / F.col("category_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    key = carried["post_id"].cast("string")
    own, every = carried.frame.agg(F.count_distinct(key), F.count("*")).first()
    if own < every:
        key = F.concat_ws(":", key, F.xxhash64(content), F.monotonically_increasing_id())
    sized = sized.withColumn("_draw", unit_draw(key, seed))
    extra = (F.col("_draw") < rate - whole).cast("long")
    joined = sized.join(targets, category.eqNullSafe(F.col("category")))
    return joined.withColumn("copies", whole + extra)


def mix(posts: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: the columns of ``posts``, each row as often as :func:`copies_of` says."""
    carried = Carried(posts)
    counted = _counted(carried, weights, share, most, seed)
    return carried.restore(counted.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))), [])
