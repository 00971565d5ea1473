"""Exact copies of posts, found with a persistent index of digests.

Contents are equal when they are identical after every run of blanks (space, tab, line feed, vertical tab, form feed,
carriage return) becomes one space.  A null content counts as empty.

Edge cases: of equal contents the post with the smallest id stays, a null id only if all are null; rows repeated with
the same id and content are all marked kept by :func:`dedup`, whose mark is a comparison of ids, and one of them stays
in :func:`keep_first`; an empty table adds nothing; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modsieve.llm.carry import Carried, one_of_each
from modsieve.session import materialize, scratch_path

#: A digest with more copies than this share of all posts is joined on its own; there are at most so many such digests.
HOT_DIGESTS = 1_000


def content_digest(content: Column) -> Column:
    """SHA-256 of the normalised content in UTF-8, lower-case hexadecimal."""
    return F.sha2(F.regexp_replace(F.coalesce(content.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


class DigestIndex:
    """A table of all contents seen so far: ``digest`` and ``post_id``, bucketed and sorted by digest.

    It lives at ``location`` under ``table`` in the session's catalog; a later session opens it again with the same two.
    """

    def __init__(self, spark: SparkSession, location: str, table: str | None = None, buckets: int = 64):
        self.spark, self.location, self.buckets = spark, location, buckets
        self.table = table or f"digest_index_{uuid.uuid4().hex}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def open(self, id_type: str = "bigint") -> DataFrame:
        """The index, for ids of that type; registered over ``location`` on first use, where files of earlier sessions may lie."""
        if not self.exists():
            self.spark.sql(
                f"create table {self.table} (digest binary, post_id {id_type}) using parquet clustered by (digest) sorted by (digest) "
                f"into {self.buckets} buckets location '{self.location}'")
        return self.spark.table(self.table)

    def append(self, found: DataFrame) -> None:
        """Add digests that are not in the index; each bucket gets one sorted file more."""
        found.select("digest", "post_id").repartition(self.buckets, "digest").write.insertInto(self.table)

    def close(self) -> None:
        """Forget the table name; the files stay."""
        self.spark.sql(f"drop table if exists {self.table}")


def dedup(posts: DataFrame, index: DigestIndex) -> DataFrame:
    """``post_id``, ``keep_id``, ``group_size``, ``kept``, ``digest`` per row, and the new digests added to the index.

    ``posts`` has ``post_id`` and ``content``.  ``keep_id`` is the post that stays for the content, from an earlier
    batch if the index has it; ``group_size`` counts the rows of this batch with the content.

    Digests are computed once and written, narrow.  One row per digest, combined before the shuffle, meets the index in
    a sort-merge anti-join on the buckets' key; what is new is appended.  The decision then goes back to the rows by the
    digest.  The few digests that hold a large share of the rows are joined apart: there can be at most a thousand of
    more than a thousandth each, so that side is small whatever the data, and no task gets all rows of a hot digest.
    """
    rows = materialize(posts.select(
        "post_id", F.unhex(content_digest(F.col("content"))).alias("digest")), "digests")
    groups = materialize(rows.groupBy("digest").agg(F.min("post_id").alias("post_id"), F.count("*").alias("group_size")), "groups")
    known = index.open(posts.schema["post_id"].dataType.simpleString())
    fresh = materialize(groups.select("digest", "post_id").join(known.hint("merge"), "digest", "left_anti"), "fresh")
    index.append(fresh)
    # from the index as it is now: the first post of every digest of this batch
    named = groups.select("digest", "group_size").join(index.open().hint("merge").select("digest", F.col("post_id").alias("keep_id")), "digest")
    named = materialize(named, "named")  # the last read of the index
    total = rows.count()
    hot = named.filter(F.col("group_size") * HOT_DIGESTS > total)
    cold = named.filter(F.col("group_size") * HOT_DIGESTS <= total)
    # at most HOT_DIGESTS rows, see above
    alone = rows.join(F.broadcast(hot), "digest")
    others = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold.hint("merge"), "digest")
    decided = alone.unionByName(others)
    return decided.select(
        "post_id", "keep_id", "group_size", F.col("post_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder; :meth:`DigestIndex.close` it when :func:`dedup` or :func:`keep_first` is back, which read it no more."""
    return DigestIndex(spark, scratch_path(spark, "digest-index"))


def keep_first(posts: DataFrame, index: DigestIndex) -> DataFrame:
    """The posts whose content was not there before, all columns, one physical row of each content.

    The ids and digests that stay are joined back, so contents are not grouped; of rows alike in both, one is picked.
    With an index of earlier batches a post comes through again under the id the index has.
    """
    decided = dedup(posts, index).filter("kept").groupBy(F.col("post_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.count("*").alias("n"))
    carried = Carried(posts)
    own = carried.frame.withColumns({"_id": carried["post_id"], "_digest": F.unhex(content_digest(carried["content"]))})
    return carried.restore(one_of_each(own, materialize(decided, "stays")), [])
