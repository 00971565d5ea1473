"""Shuffle posts into shards by a permutation of their global row numbers.

Edge cases: null contents have size 1; posts with equal or null ids are numbered one after the other;
repeated rows get places of their own; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modsieve.llm.order import with_row_numbers

PRIME = 2_147_483_647
#: Odd multipliers and offsets of the rounds, one pair each.
ROUNDS = [(48_271, 11), (69_621, 101), (16_807, 1_009), (39_373, 10_007), (40_692, 100_003), (45_991, 1_000_003)]


def half_bits(rows: int) -> int:
    """Bits of each half of the smallest balanced network over at least ``rows`` values."""
    return max(1, ((max(rows, 1) - 1).bit_length() + 1) // 2)


def _round(value, multiplier: int, offset: int, seed: int, mask: int):
    mixed = (value + np.uint64(offset + seed % 1_000_003)) % np.uint64(PRIME)
    mixed = (mixed * mixed + np.uint64(multiplier)) % np.uint64(PRIME)
    return ((mixed * np.uint64(multiplier)) % np.uint64(PRIME) >> np.uint64(5)) & np.uint64(mask)


def _network(values: np.ndarray, bits: int, seed: int, rounds) -> np.ndarray:
    shift, mask = np.uint64(bits), (1 << bits) - 1
    left, right = values >> shift, values & np.uint64(mask)
    for multiplier, offset in rounds:
        left, right = right, left ^ _round(right, multiplier, offset, seed, mask)
    return left << shift | right


def permute(numbers: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """The place of each row number in a permutation of ``0 … rows - 1``.

    A Feistel network permutes the next power of four; values outside the range walk on along their cycle until they
    come back into it.  The cycle starts inside the range, so it does.
    """
    bits = half_bits(rows)
    out = _network(np.asarray(numbers, np.uint64), bits, seed, ROUNDS)
    while (outside := out >= rows).any():
        out[outside] = _network(out[outside], bits, seed, ROUNDS)
    return out.astype(np.int64)


def restore(places: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """The row number of each place: the rounds backwards, walking the same cycle the other way."""
    bits = half_bits(rows)

    def swap(values):
        return (values & np.uint64((1 << bits) - 1)) << np.uint64(bits) | values >> np.uint64(bits)

    def back(values):
        return swap(_network(swap(values), bits, seed, ROUNDS[::-1]))

    out = back(np.asarray(places, np.uint64))
    while (outside := out >= rows).any():
        out[outside] = back(out[outside])
    return out.astype(np.int64)


def shard_posts(posts: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """One row per post: ``post_id``, ``size``, ``content_crc32``, ``row_number``, ``place``, ``shard``, ``slot``.

    ``posts`` has ``post_id`` and ``content``.  Rows are numbered in the order of their ids (then size and checksum);
    the permuted number is the ``place`` of the post in the shuffled corpus, its shard the place modulo ``shards`` and its
    slot the quotient.  So shard counts differ by one at most, slots are gapless, and :func:`restore` computes which row
    lies in any slot without a table.  Only ids, sizes and checksums are shuffled.
    """
    content = F.coalesce(F.col("content").cast("string"), F.lit(""))
    narrow = posts.select(
        F.col("post_id").alias("post_id"), (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("content_crc32"))
    numbered = with_row_numbers(narrow, ["post_id", "size", "content_crc32"])
    rows = numbered.count()

    @F.pandas_udf("long")
    def place(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for n in numbers:
            yield pd.Series(permute(n.to_numpy(), rows, seed))

    return numbered.withColumn("place", place("row_number")).withColumns({
        "shard": F.pmod("place", F.lit(shards)).cast("int"), "slot": F.floor(F.col("place") / F.lit(shards)).cast("long")})
