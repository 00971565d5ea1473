"""Near copies of posts by SimHash fingerprints and multi-index hashing.

Every segment of a fingerprint has a table keyed by the segment's value.  A fingerprint looks up all values within one bit of its own in
each table, and what it finds there is compared with it in full.

Edge cases: a content without words, null or empty, has the fingerprint zero and is linked like any other; a
content of fewer words than a shingle is one shingle; repeated shingles count as often as they occur; repeated rows
have equal fingerprints; posts with a null id are in components but never name one unless all ids there are null;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsieve.llm.components import connected_components
from modsieve.session import materialize

BITS = 64
SEED = 42
#: Fingerprints link at so many differing bits or fewer; a segment's ball has radius one, so two segments are enough.
RADIUS, SEGMENTS = 2, 2
WIDTH = BITS // SEGMENTS
#: Bits of one of the three parts a segment is cut into where a bucket is split.
PART = -(-WIDTH // (RADIUS + 1))
#: Fingerprints of a bucket that are compared all with all.
HOT = 64
#: Shingle hashes counted at once: bounds the memory of a long content.
CHUNK = 65_536


def fingerprint(text: str, words: int = 3) -> int:
    """Bit ``k`` is set if it is set in over half of the shingles' XXH64 values."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(b" ".join(tokens), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(tokens[k:] for k in range(words)))]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The fingerprint of some shingle hashes; zero for none."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = np.array(hashes[start : start + CHUNK], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(posts: DataFrame, words: int = 3, *keep: str) -> DataFrame:
    """``post_id``, ``fingerprint`` (its 64 bits as a signed long) of every whole content, A-Z in lower case, and the columns ``keep``."""

    @F.pandas_udf("long")
    def of(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for content in contents:
            values = np.array([0 if t is None else fingerprint(t, words) for t in content], np.uint64)
            yield pd.Series(values.view(np.int64))

    return posts.select(F.col("post_id").alias("post_id"), of(F.col("content").cast("string")).alias("fingerprint"), *keep)


def segment_value(value: Column, k: int) -> Column:
    """Segment ``k`` of a fingerprint, as a number."""
    return F.shiftrightunsigned(value, k * WIDTH).bitwiseAND((1 << WIDTH) - 1)


def segment_tables(prints: DataFrame) -> DataFrame:
    """``segment``, ``value``, ``fingerprint``: a table for every segment, keyed by what the segment holds."""
    entries = F.array(*[F.struct(F.lit(k).alias("segment"), segment_value(F.col("fingerprint"), k).alias("value")) for k in range(SEGMENTS)])
    return prints.select("fingerprint", F.explode(entries).alias("entry")).select("entry.*", "fingerprint")


def segment_balls(prints: DataFrame) -> DataFrame:
    """``segment``, ``value``, ``fingerprint``: all values within one bit of what a segment of the fingerprint holds."""
    def ball(k: int) -> Column:
        value = segment_value(F.col("fingerprint"), k)
        flipped = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda bit: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))
        return F.transform(F.concat(F.array(value), flipped), lambda v: F.struct(F.lit(k).alias("segment"), v.alias("value")))

    # dozens of rows come out for each that goes in: the few bytes that go in are dealt out again first, by a key of their own,
    # since a deal by the fingerprint would be merged with the one before and its small parts put together
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prints.repartition(tasks, F.xxhash64("fingerprint"))
    return dealt.select("fingerprint", F.explode(F.concat(*map(ball, range(SEGMENTS)))).alias("entry")).select("entry.*", "fingerprint")


def _split(entries: DataFrame) -> DataFrame:
    """Each entry under every part of its other segment: two values of that segment within two bits agree in one of three parts."""
    other = F.when(F.col("segment") == 0, segment_value(F.col("fingerprint"), 1)).otherwise(segment_value(F.col("fingerprint"), 0))
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.shiftright(other, k * PART).bitwiseAND((1 << PART) - 1).alias("held")) for k in range(RADIUS + 1)])
    return entries.select("*", F.explode(parts).alias("_part")).select(*entries.columns, "_part.*")


def candidates(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs ``a`` > ``b`` of distinct fingerprints one of whose segments differ in at most one bit; ``prints`` is distinct.

    Of two fingerprints within two bits one segment differs in at most one, so all links are among these.  A bucket of a
    table with over ``hot`` fingerprints is split by parts of the other segment, which still loses no link.  Spark takes exploded
    rows to be as many as those that went in and would broadcast the balls, so their joins are told to sort and merge.
    """
    table, balls = materialize(segment_tables(prints), "segment_tables"), segment_balls(prints)
    crowded = materialize(table.groupBy("segment", "value").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("segment", "value"), "crowded")
    named = table.withColumnRenamed("fingerprint", "b")
    keys = ["segment", "value"]
    found = balls.withColumnRenamed("fingerprint", "a").hint("merge").join(named.join(crowded, keys, "left_anti"), keys).select("a", "b")
    if not crowded.isEmpty():
        split = _split(balls.join(crowded, keys, "left_semi")).withColumnRenamed("fingerprint", "a")
        found = found.union(split.hint("merge").join(_split(table.join(crowded, keys, "left_semi")).withColumnRenamed("fingerprint", "b"), [*keys, "part", "held"]).select("a", "b"))
    return found.filter("a > b")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """The :func:`candidates` whose complete distance is at most two."""
    return candidates(prints).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def rooted(nodes: DataFrame) -> DataFrame:
    """``nodes`` (distinct fingerprints) with ``root``, the smallest fingerprint reachable over links."""
    roots = connected_components(fingerprint_links(nodes.select("fingerprint")))
    return nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select(*nodes.columns, F.coalesce("root", "fingerprint").alias("root"))


def near_copies(posts: DataFrame, words: int = 3) -> DataFrame:
    """``post_id``, ``fingerprint`` and ``component_id``, the smallest ``post_id`` reachable over links.

    Posts with one fingerprint are one node, so copies never make pairs.  Fingerprints are written once; links and
    components see distinct values only.  The component joins back on the fingerprint, which adaptive execution splits
    where many posts share it.
    """
    written = materialize(fingerprints(posts, words), "fingerprints")
    named = materialize(rooted(written.groupBy("fingerprint").agg(F.min("post_id").alias("first"))), "nodes")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    component = materialize(named.join(smallest, "root").select(F.col("fingerprint").alias("node"), "component_id"), "components")
    return written.join(component, F.col("fingerprint") == F.col("node"), "left").select("post_id", "fingerprint", "component_id")


def text_digest(content: Column) -> Column:
    """SHA-256 of the whole content; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(content.cast("string"), F.lit("")), 256))


def hex_digits(value: Column) -> Column:
    """A 64-bit value as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")
