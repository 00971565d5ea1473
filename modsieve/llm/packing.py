"""Pack posts into sequences of one length: concatenate all tokens, cut at fixed places.

Edge cases: a null or empty content is the end token alone; repeated rows are packed as often as they occur; a content
longer than a sequence is cut into as many pieces as it needs; an empty table gives no piece; the last sequence alone
is not full; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsieve.llm.order import starts
from modsieve.llm.vocabulary import open_vocabulary
from modsieve.session import materialize

#: Bytes of ids in one Arrow batch; a longer content is a batch of its own.
BATCH_BYTES = 4_000_000


def tokenized(posts: DataFrame, vocabulary_path: str, end_id: int) -> DataFrame:
    """First pass, written: ``post_id``, ``ids``, ``n_tokens``, ``part`` and ``before``.

    ``ids`` are the ids of the content and ``end_id``, little-endian, two bytes each if the vocabulary allows, else
    four; ``part`` is the task that read the post, ``before`` the tokens this task had before it.
    """
    source = posts.select(F.col("post_id").alias("post_id"), F.col("content").cast("string").alias("content"), F.spark_partition_id().alias("part"))
    schema = T.StructType([
        T.StructField("post_id", source.schema["post_id"].dataType), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = open_vocabulary(vocabulary_path)
        kind = "<u2" if max(vocabulary.size, end_id + 1) <= 1 << 16 else "<u4"
        end, before = np.array([end_id], kind).tobytes(), 0

        def batch_of(batch, start, ids, sizes, firsts):
            part = batch.slice(start, len(ids))
            return pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), part.column(2), pa.array(firsts, pa.int64())],
                names=["post_id", "ids", "n_tokens", "part", "before"])

        for batch in batches:
            start, volume, ids, sizes, firsts = 0, 0, [], [], []
            for k in range(batch.num_rows):
                wide = vocabulary.ids(batch.column(1)[k].as_py() or "")
                ids.append((wide if kind == "<u4" else np.frombuffer(wide, "<u4").astype(kind).tobytes()) + end)
                sizes.append(len(wide) // 4 + 1)
                firsts.append(before)
                before += sizes[-1]
                volume += len(ids[-1])
                if volume >= BATCH_BYTES:
                    yield batch_of(batch, start, ids, sizes, firsts)
                    start, volume, ids, sizes, firsts = k + 1, 0, [], [], []
            if ids:
                yield batch_of(batch, start, ids, sizes, firsts)

    return materialize(source.mapInArrow(encode, schema), "tokens")


def pack(posts: DataFrame, vocabulary_path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: ``post_id``, ``start``, ``length``, ``ids_crc32``, ``n_tokens``, ``sequence_id``, ``offset``.

    ``posts`` has ``post_id`` and ``content``.  Two passes: tasks write their tokens and running totals, then the totals
    of all tasks, one row each, are summed into the global offset of every task.  A post's tokens begin at the sum of
    both offsets; multiples of ``length`` cut it, and a piece is the record of a post between two cuts.  Only the last
    sequence is padded.  Nothing is shuffled but the totals, and no task needs more than its own posts.
    """
    tokens = tokenized(posts, vocabulary_path, end_id)
    base = materialize(starts(tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")), "part", "n").withColumnRenamed("start", "base"), "bases")
    # one row per task of the first pass
    placed = tokens.join(F.broadcast(base), "part").select("post_id", "ids", "n_tokens", (F.col("base") + F.col("before")).alias("at"))
    schema = T.StructType([
        T.StructField("post_id", placed.schema["post_id"].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], [[] for _ in range(6)]
            for k in range(batch.num_rows):
                raw, size, at = batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                wide = np.frombuffer(raw, f"<u{len(raw) // size}").astype("<u4").tobytes()
                start = 0
                while start < size:
                    sequence, offset = divmod(at + start, length)
                    stop = min(size, start + length - offset)
                    rows.append(k)
                    for column, value in zip(out, (start, stop - start, zlib.crc32(wide[4 * start : 4 * stop]), size, sequence, offset)):
                        column.append(value)
                    start = stop
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in out)], names=schema.names)

    return placed.mapInArrow(cut, schema)
