"""Keyword files: a JSON list of strings, order matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from modsieve import constants as K
from modsieve.functions.text import squash
from modsieve.operators.lexicon import GAP


def lexicon_load(spark: SparkSession, path: str, default: list[str] | None = None) -> DataFrame:
    """``kw_idx, keyword, pattern`` from a JSON list; the default list when it is missing or unreadable.

    Keywords that squash to nothing would hit every post and are left out.
    """
    fallback = K.DEFAULT_RULE_KEYWORDS if default is None else default
    try:
        document = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("list"))
        readable = document.filter("list is not null and size(list) > 0 and list[0] is not null").limit(1).count() > 0
    except AnalysisException:
        readable = False
    if readable:
        pairs = document.select(F.posexplode("list").alias("kw_idx", "keyword"))
    else:
        pairs = spark.createDataFrame(list(enumerate(fallback)), "kw_idx int, keyword string")
    return with_patterns(pairs)


def with_patterns(pairs: DataFrame) -> DataFrame:
    """Add the fuzzy pattern of each keyword: its squashed characters with small gaps allowed."""
    letters = F.filter(F.split(squash(F.col("keyword")), ""), lambda c: c != "")
    return pairs.withColumn("pattern", F.array_join(letters, GAP)).filter("pattern <> ''")


def lexicon_save(keywords: DataFrame, path: str) -> None:
    """Write ``kw_idx, keyword`` as one JSON list, a keyword a line.

    The list has to be one file, so one task writes it, but row by row from sorted partitions: nothing grows in memory.
    """
    spark = keywords.sparkSession
    quoted = F.regexp_replace(F.to_json(F.array("keyword")), r"^\[|\]$", "")
    numbered = keywords.select(F.col("kw_idx").cast("long").alias("kw_idx"), F.concat(quoted, F.lit(",")).alias("value"))
    last = keywords.agg(F.max("kw_idx").cast("long").alias("last"))
    lines = numbered.join(F.broadcast(last), F.col("kw_idx") == F.col("last"), "left").select(
        F.struct(F.lit(1).alias("part"), "kw_idx").alias("at"),
        F.when(F.col("last").isNotNull(), F.rtrim("value", F.lit(","))).otherwise(F.col("value")).alias("value"))
    ends = spark.createDataFrame([(0, "["), (2, "]")], "part int, value string").select(
        F.struct("part", F.lit(0).cast("long").alias("kw_idx")).alias("at"), "value")
    lines.unionByName(ends).orderBy("at").select("value").coalesce(1).write.mode("overwrite").text(path)
