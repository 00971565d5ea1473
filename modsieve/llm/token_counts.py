"""Token counts of every prefix of a post: truncation and budgets without encoding again.

Edge cases, here and in the functions below: a null or empty content has no prefix and 0 tokens; rows that
occur twice are counted twice; other columns of the posts pass through ``keep``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsieve.llm.vocabulary import open_vocabulary

#: Code points sent back to Spark in one Arrow batch; a longer text is a batch of its own.
BATCH_CHARS = 2_000_000


def prefix_token_counts(posts: DataFrame, vocabulary_path: str, keep: list[str] | None = None) -> DataFrame:
    """One row per post: ``post_id``, ``prefix_tokens``, ``n_tokens`` and the columns named in ``keep``.

    ``posts`` has ``post_id`` and ``content``.  ``prefix_tokens[i]`` is the exact number of tokens of the
    first ``i + 1`` code points, as the vocabulary's library counts them without added special tokens.
    Special strings inside a content are special tokens, the library's default.  Positions are those of
    the composed, lower-cased content, which are the content's own unless either changes its length.

    The counts come from prefix dynamic programming inside words, see ``Vocabulary.prefix_counts``; words
    and blanks are independent of each other, so a running sum joins them.  Map only: no shuffle, memory
    bounded by one Arrow batch and the word memo.
    """
    kept = [F.col(f"`{c}`") for c in keep or []]
    source = posts.select(F.col("post_id").alias("post_id"), F.col("content").cast("string").alias("content"), F.struct(*kept).alias("kept") if kept else F.lit(None).cast("int").alias("kept"))
    schema = T.StructType([
        source.schema["post_id"], T.StructField("prefix_tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
        source.schema["kept"],
    ])
    # every field may be null whatever the input promised
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = open_vocabulary(vocabulary_path)
        for batch in batches:
            content, start = batch.column(1), 0
            arrays: list[np.ndarray] = []
            chars = 0

            def flush(stop: int):
                sizes = np.array([0, *map(len, arrays)])
                values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
                totals = pa.array([int(a[-1]) if len(a) else 0 for a in arrays], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(values, pa.int32()))
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), lists, totals, batch.column(2).slice(start, stop - start)],
                    names=["post_id", "prefix_tokens", "n_tokens", "kept"],
                )

            for k in range(batch.num_rows):
                text = content[k].as_py() or ""
                counts = vocabulary.counts(text)
                arrays.append(counts)
                chars += len(counts)
                if chars >= BATCH_CHARS:
                    yield flush(k + 1)
                    start, arrays, chars = k + 1, [], 0
            if arrays:
                yield flush(batch.num_rows)

    counted = source.mapInArrow(count, schema)
    return counted.select("post_id", "prefix_tokens", "n_tokens", *([F.col("kept")[c].alias(c) for c in keep] if keep else []))


def tokens_of_prefix(prefix_tokens: Column, size: Column | int) -> Column:
    """Tokens of the first ``size`` code points; sizes beyond the end count the whole content, sizes below one nothing."""
    size = F.least(F.lit(size) if isinstance(size, int) else size, F.size(prefix_tokens))
    return F.when(size < 1, F.lit(0)).otherwise(F.get(prefix_tokens, size - 1))


def over_budget(n_tokens: Column, budget: int) -> Column:
    """Whether a content has more than ``budget`` tokens."""
    return n_tokens > budget


def longest_prefix(prefix_tokens: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens.

    A longer prefix may have fewer tokens than a shorter one, so the last fitting position counts, not the first
    that does not fit.  The whole content is tried first, then positions from the end.
    """
    total = F.coalesce(F.try_element_at(prefix_tokens, F.lit(-1)), F.lit(0))
    fitting = F.array_position(F.transform(F.reverse(prefix_tokens), lambda n: n <= budget), True)
    found = F.when(fitting > 0, F.size(prefix_tokens) - fitting + 1).otherwise(F.lit(0))
    return F.when(total <= budget, F.size(prefix_tokens)).otherwise(found).cast("long")
