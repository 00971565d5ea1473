"""The same operators on Structured Streaming.

All jobs run with ``availableNow`` here and write below the shared checkpoint folder; for a
continuous job pass another trigger.  Per-batch outputs are keyed by batch id and overwritten when
a batch is replayed, so a lost executor or driver never doubles a row.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from modsieve.functions.text import copy_key
from modsieve.operators.review import latest_command
from modsieve.session import materialize

def read_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def append_sink(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def batch_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_moderate(posts: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Batch and stream share the stateless decision plan."""
    return decide(posts)


def stream_posts_per_hour(posts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Hourly counts, for update mode: every batch emits the hours it has changed, open ones too, with their counts so far.

    A post is counted if its hour ends after the latest time of all earlier batches less ``late``; later ones are dropped, and the state
    holds such hours only.  :func:`latest_per_key` over a :func:`versioned_writer` log is the whole result, at any moment.
    """
    return (
        posts.withWatermark("created_at", late).groupBy(F.window("created_at", "1 hour")).agg(F.count("*").alias("posts"))
        .select(F.col("window")["start"].alias("hour"), "posts")
    )


def _file_system(spark: SparkSession, folder: str):
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(sc._jsc.hadoopConfiguration()), path


def _numbered(spark: SparkSession, folder: str, prefix: str) -> dict[int, str]:
    """Numbers and paths of the folders below ``folder`` whose names are the prefix and a number."""
    fs, path = _file_system(spark, folder)
    if not fs.exists(path(folder)):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(path(folder))]
    return {int(n[len(prefix):]): f"{folder}/{n}" for n in names if n.startswith(prefix) and n[len(prefix):].isdigit()}


def snapshots(out: str) -> str:
    return f"{out}-snapshots"


def override_log(spark: SparkSession, out: str) -> DataFrame | None:
    """The newest snapshot and all batches after it; None if there is neither."""
    kept = _numbered(spark, snapshots(out), "upto=")
    newest = max(kept, default=-1)
    paths = [p for n, p in _numbered(spark, out, "batch=").items() if n > newest]
    parts = [spark.read.parquet(p) for p in [*([kept[newest]] if kept else []), *paths]]
    return functools.reduce(DataFrame.unionByName, parts) if parts else None


def compaction_steps(spark: SparkSession, out: str) -> Iterator[int]:
    """The steps of :func:`compact_overrides`; one may stop after any of them, now or for ever, and nothing is lost.

    The reduced log is written under a name no reader knows, then takes the name of a snapshot in one rename.  From then on
    readers take it in place of the batches it holds.  Only then what it replaces goes: the batches that the snapshot before
    it held, and older snapshots, so that a reader which had chosen these still finds them.
    """
    fs, path = _file_system(spark, out)
    batches, kept = _numbered(spark, out, "batch="), _numbered(spark, snapshots(out), "upto=")
    before, newest = max(kept, default=-1), max([*batches, *kept], default=-1)
    if newest > before:
        fresh = f"{snapshots(out)}/fresh-{uuid.uuid4().hex}"
        latest_command(override_log(spark, out), "override_value").write.parquet(fresh)
        yield newest
        if not fs.rename(path(fresh), path(f"{snapshots(out)}/upto={newest}")):
            raise OSError(f"could not name the snapshot up to batch {newest}")
        yield newest
    for number, folder in [*((n, f) for n, f in sorted(batches.items()) if n <= before), *((n, f) for n, f in sorted(kept.items()) if n < before)]:
        fs.delete(path(folder), True)
        yield newest


def compact_overrides(spark: SparkSession, out: str) -> int:
    """Reduce the override log to the last override per post; returns the number of the last batch that is in.

    A read then costs the overridden posts and the batches since, not all batches.  It may run beside the stream: a
    batch that is replayed while it runs is in the snapshot or after it with the same rows.
    """
    return max(compaction_steps(spark, out), default=-1)


def stream_stage_stats(posts: DataFrame, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """Running time statistics per window, stage and band, for update mode."""
    return (
        posts.withWatermark("created_at", late)
        .groupBy(F.window("created_at", every), "stage", "band")
        .agg(F.count("*").alias("posts"), F.sum("processing_time").alias("time_sum"))
        .select(F.col("window")["start"].alias("window_start"), "stage", "band", "posts", "time_sum",
                (F.col("time_sum") / F.col("posts")).alias("avg_time"))
    )


def versioned_writer(out: str) -> Callable[[DataFrame, int], None]:
    """Each batch overwrites its own folder: replays are harmless."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def latest_per_key(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Current state from the update log: the row of the highest batch per key."""
    log = spark.read.parquet(out)
    values = [c for c in log.columns if c not in keys and c != "batch"]
    newest = log.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("_new"))
    return newest.select(*keys, *[F.col("_new")[v].alias(v) for v in values])


def override_writer(out: str) -> Callable[[DataFrame, int], None]:
    """Reduce each batch to the last override per post and log it under its batch id.

    A batch costs what it holds, however many overrides came before; :func:`current_overrides`
    resolves the log at read time, from the newest snapshot of :func:`compact_overrides` on.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_command(batch, "override_value").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def current_overrides(spark: SparkSession, out: str) -> DataFrame:
    """The last override per post over all batches so far."""
    return latest_command(override_log(spark, out), "override_value")


class CopyTable:
    """The first post of every content ever seen, outside the stream's state: no horizon.

    A table ``copy, <key>, created_at`` at ``location``, a partition for each batch, bucketed by ``copy``, so that a batch meets it without
    moving it.  A batch that is replayed overwrites its own partition and looks at earlier ones only: the result is the same.
    """

    def __init__(self, spark: SparkSession, location: str, key: str = "post_id", key_type: str = "bigint", buckets: int = 32):
        self.spark, self.location, self.key, self.buckets = spark, location, key, buckets
        self.table = f"copies_{uuid.uuid4().hex}"
        spark.sql(f"create table {self.table} (copy string, {key} {key_type}, created_at timestamp, batch bigint) using parquet "
                  f"partitioned by (batch) clustered by (copy) into {buckets} buckets location '{location}'")
        fs, path = _file_system(spark, location)
        if fs.exists(path(location)):
            spark.sql(f"msck repair table {self.table}")

    def rows(self) -> DataFrame:
        """The posts that stayed, with the batch they came in."""
        return self.spark.table(self.table)

    def close(self) -> None:
        """Forget the table's name; the files stay for the next run."""
        self.spark.sql(f"drop table if exists {self.table}")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Keep the first post of every content the table does not have; ``batch`` has the key, ``content`` and ``created_at``.

        Copies in a batch are reduced in the tasks that read them, so a content with a third of the rows is one row a task after that.
        """
        session = batch.sparkSession
        first = batch.groupBy(copy_key(F.col("content")).alias("copy")).agg(F.min(F.struct("created_at", self.key)).alias("first"))
        seen = session.table(self.table).filter(F.col("batch") < batch_id).select("copy")
        fresh = first.join(seen.hint("merge"), "copy", "left_anti").select("copy", f"first.{self.key}", "first.created_at")
        # a table cannot be overwritten, not even one partition of it, in a job that reads it
        materialize(fresh, "fresh_copies").repartition(self.buckets, "copy").createOrReplaceTempView(f"{self.table}_fresh")
        session.sql(f"insert overwrite table {self.table} partition (batch = {batch_id}) select * from {self.table}_fresh")
        session.catalog.dropTempView(f"{self.table}_fresh")


def stream_running_totals(posts: DataFrame) -> DataFrame:
    """All counts so far per stage and threat, for complete mode; the state is a handful of rows."""
    return posts.groupBy("stage", "threat_level").agg(
        F.count("*").alias("posts"), F.count_if("accepted").alias("accepted"))
