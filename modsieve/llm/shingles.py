"""Near copies of posts by the Jaccard similarity of their word shingles: at least 80 of 100 of five words each.

SimHash comes first: fingerprints of the shingle sets, linked within two bits by multi-index hashing.  It finds almost unchanged texts
only: texts of similarity 0.8 and more differ in up to 17 of 64 bits, a radius at which unrelated texts match as well.  Min-hashes in
bands add candidates for these; texts of a crowded band are searched exactly, by the rarest of their shingles.  Every link is verified on the
complete shingle sets.

Edge cases: a content without words, null or empty, has the empty set, and all of those are one group; a content of fewer
words than a shingle is one shingle; a shingle counts once, however often it occurs; contents with equal sets are one node;
an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsieve.llm.carry import Carried, one_of_each
from modsieve.llm.components import connected_components
from modsieve.llm.simhash import fingerprint_links, majority, text_digest
from modsieve.session import materialize

SEED = 42
WORDS = 5
#: Links join sets with at least so many hundredths of their union in common.
PERCENT = 80
#: A pair at the threshold meets in none of the bands once in 14,000 pairs: (1 - 0.8 ** 5) ** 24.
BANDS, ROWS = 24, 5
#: Shingles hashed at once: bounds the memory of a long content.
CHUNK = 8_192
#: Members of one entry of a band that are compared all with all.  Entries with more are crowded: they are dealt into groups of about this
#: size, in every band by another hash, where neighbours are compared; what is still apart then is searched by :func:`crowd_pairs`.
GROUP = 32
#: Counters of shingles of crowded texts, a byte each, whatever the number of texts.
CELL_BITS = 20


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 values of the shingles, sorted, each once; A-Z in lower case."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(b" ".join(tokens), SEED)], np.uint64)
    return np.unique(np.array([digest(b" ".join(s), SEED) for s in zip(*(tokens[k:] for k in range(words)))], np.uint64))


@functools.cache
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    """One mask and one odd factor per min-hash."""
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64),
            rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1))


def band_values(hashes: np.ndarray) -> list[int]:
    """One signed long per band, equal for two sets if the band's min-hashes are; none for the empty set."""
    import xxhash

    if not len(hashes):
        return []
    mask, odd = _mixers()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), CHUNK):
        mixed = (hashes[None, start : start + CHUNK] ^ mask) * odd
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=1))
    values = [xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(values, np.uint64).view(np.int64).tolist()


def signatures(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """``_id``, ``_digest``, ``alike`` (a digest of the shingle set), ``bands`` and ``fingerprint`` (of the set) of every content."""

    @F.pandas_udf("alike binary, bands array<bigint>, fingerprint bigint")
    def of(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for content in contents:
            sets = [shingle_hashes(text, words) for text in content]
            prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"alike": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "bands": [band_values(s) for s in sets], "fingerprint": prints})

    found = rows.select("_id", "_digest", of(F.col("content").cast("string")).alias("found"))
    return found.select("_id", "_digest", "found.alike", "found.bands", "found.fingerprint")


def hash_sets(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """``node`` and ``hashes``, its shingle set."""

    @F.pandas_udf("array<bigint>")
    def of(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for content in contents:
            yield pd.Series([shingle_hashes(text, words).view(np.int64) for text in content])

    return rows.select("node", of(F.col("content").cast("string")).alias("hashes"))


def shared_entries(nodes: DataFrame) -> DataFrame:
    """``node``, ``entry`` and its number ``n`` of nodes, for the entries that more than one node has.

    Spark takes the exploded bands to be as many rows as the nodes and would broadcast the counts of all entries, so the join is told to sort and merge.
    """
    table = nodes.select("node", F.explode("bands").alias("entry"))
    return table.join(table.groupBy("entry").agg(F.count("*").alias("n")).filter("n > 1").hint("merge"), "entry")


def grouped(shared: DataFrame) -> DataFrame:
    """Lists of ``members`` (structs of ``node``, ``root``) that share an entry, in a scattered order; ``shared`` has ``node``, ``root``, ``entry``, ``n``.

    An entry with many members is dealt into groups, so no task gets all of them and no group grows with the data.
    """
    dealt = shared.withColumn("scatter", F.xxhash64("node", "entry")).withColumn("part", F.pmod("scatter", F.ceil(F.col("n") / GROUP)))
    return dealt.groupBy("entry", "part").agg(
        F.sort_array(F.collect_list(F.struct("scatter", "node", "root"))).alias("members")).filter(F.size("members") > 1)


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs by SimHash: nodes within two bits, by the smallest node of each fingerprint; the others of a fingerprint with that one."""
    named = materialize(nodes.groupBy("fingerprint").agg(F.min("node").alias("least")), "fingerprints")
    links = fingerprint_links(named.select("fingerprint")).withColumnsRenamed({"a": "_a", "b": "_b"})
    ends = [named.select(F.col("fingerprint").alias(f"_{e}"), F.col("least").alias(e)).hint("merge") for e in "ab"]
    apart = links.join(ends[0], "_a").join(ends[1], "_b").select("a", "b")
    same = nodes.select("node", "fingerprint").join(named, "fingerprint").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return ordered(apart.union(same))


def neighbours(groups: DataFrame) -> DataFrame:
    """Each member with the next one of its list."""
    pair = F.transform(F.expr("slice(members, 2, size(members) - 1)"), lambda m, k: F.struct(m["node"].alias("a"), F.get("members", k)["node"].alias("b")))
    return ordered(groups.select(F.explode(pair).alias("pair")).select("pair.a", "pair.b"))


def strangers(groups: DataFrame) -> DataFrame:
    """All pairs of members with different roots."""
    pairs = F.flatten(F.transform("members", lambda m, k: F.transform(
        F.filter(F.slice("members", k + 2, F.size("members")), lambda o: o["root"] != m["root"]), lambda o: F.struct(m["node"].alias("a"), o["node"].alias("b")))))
    return ordered(groups.select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b"))


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def holders(sets: DataFrame) -> np.ndarray:
    """By the first bits of a shingle's hash: how many ``hashes`` there are in all ``sets``, up to 255; never less than hold the shingle."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros(1 << CELL_BITS, np.uint8), False
        for batch in batches:
            cells, n = np.unique(_cells(batch.column(0).flatten().to_numpy()), return_counts=True)
            counts[cells], some = np.minimum(counts[cells] + n, 255), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    def summed(x: bytes, y: bytes) -> bytes:
        both = np.frombuffer(x, np.uint8).astype(np.int64) + np.frombuffer(y, np.uint8)
        return np.minimum(both, 255).astype(np.uint8).tobytes()

    parts = sets.select("hashes").mapInArrow(of, "counts binary").rdd.map(lambda row: bytes(row[0]))
    return np.frombuffer(parts.treeAggregate(bytes(1 << CELL_BITS), summed, summed), np.uint8)


def prefixes(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """``node``, ``root``, ``size``, ``entry``, ``rest``, ``bits``: the first shingles of every set, the rarest first by ``counts``, then by their hash.

    All sets have one order.  Of two sets that are alike, the first shingle they share is among these of both, and both have at least as
    many as they share left from there on: ``rest``.  Each of 256 ``bits`` tells whether the set has an odd number of the shingles whose hash begins with
    its number.  A shingle of a single set is left out.  Any ``counts`` that are not too low give the same links; good ones give few pairs.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, root, lists = (batch.column(k) for k in range(3))
            found = []
            for k in range(len(lists)):
                hashes = lists[k].values.to_numpy()
                size, n = len(hashes), counts[_cells(hashes)]
                first = np.lexsort((hashes, n))[: size - -(-PERCENT * size // 100) + 1]
                shared = np.flatnonzero(n[first] > 1)
                bits = np.packbits(np.bincount((hashes.view(np.uint64) >> np.uint64(56)).astype(np.int64), minlength=256) & 1).view(np.int64)
                found.append((np.full(len(shared), k), np.full(len(shared), size), hashes[first[shared]], size - shared, np.tile(bits, len(shared))))
            row, size, entry, rest, bits = (pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * 4), bits)
            yield pa.RecordBatch.from_arrays([node.take(row), root.take(row), size, entry, rest, bits], ["node", "root", "size", "entry", "rest", "bits"])

    return sets.select("node", "root", "hashes").mapInArrow(of, "node long, root long, size long, entry long, rest long, bits array<bigint>")


def may_be_alike(x: Column, y: Column) -> Column:
    """Whether two sets (structs of ``size``, ``rest``) that share no shingle before these can still have enough in common."""
    return F.least(x["rest"], y["rest"]) * (100 + PERCENT) >= (x["size"] + y["size"]) * PERCENT


def too_far_apart(x: Column, y: Column) -> Column:
    """Whether more ``bits`` differ than alike sets have shingles of their own: every shingle of one set alone turns one bit."""
    turned = sum(F.bit_count(x["bits"][k].bitwiseXOR(y["bits"][k])) for k in range(4))
    return turned * (100 + PERCENT) > (x["size"] + y["size"]) * (100 - PERCENT)


def crowd_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of different roots with every pair among them whose ``sets`` (``node``, ``root``, ``hashes``) are alike.

    Texts that share a long passage and differ in the rest have their own shingles first, so the passage makes no pairs.  Members of one root that share an
    entry are lists of about ``GROUP``: lists are compared by the bounds of their members, members only where those leave it open, and those of one root never.
    """
    table = materialize(prefixes(sets, holders(sets)), "prefixes")
    held = table.join(table.groupBy("entry").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("entry"), "entry")
    sized = held.join(held.groupBy("entry", "root").agg(F.count("*").alias("n")), ["entry", "root"])
    part = F.pmod(F.xxhash64("node", "entry"), F.ceil(F.col("n") / GROUP))
    lists = materialize(sized.groupBy("entry", "root", part.alias("part")).agg(
        F.struct(F.min("size").alias("size"), F.max("rest").alias("rest")).alias("bound"), F.collect_list(F.struct("node", "size", "rest", "bits")).alias("members")), "lists")
    x, y = (lists.select("entry", *[F.col(c).alias(f"{c}_{e}") for c in ("root", "bound", "members")]) for e in "xy")
    met = x.join(y, "entry").filter((F.col("root_x") < F.col("root_y")) & may_be_alike(F.col("bound_x"), F.col("bound_y")))
    pairs = F.flatten(F.transform("members_x", lambda m: F.transform(
        F.filter("members_y", lambda o: may_be_alike(m, o) & ~too_far_apart(m, o)), lambda o: F.struct(m["node"].alias("a"), o["node"].alias("b")))))
    return ordered(met.select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def alike(x: Column, y: Column) -> Column:
    """Whether two sets have at least ``PERCENT`` hundredths of their union in common."""
    common = F.size(F.array_intersect(x, y))
    return common * 100 >= (F.size(x) + F.size(y) - common) * PERCENT


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` whose complete shingle ``sets`` are alike."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return both.filter(alike(F.col("x"), F.col("y"))).select("a", "b")


def rooted(nodes: DataFrame, rows: DataFrame, words: int = WORDS) -> DataFrame:
    """``nodes`` (``node``, ``first``, ``bands``, ``fingerprint``) with ``root``, the smallest node reachable over verified links.

    Only texts that are in a pair of SimHash or share an entry are read again.  Two passes: the first verifies the pairs of SimHash and neighbours
    in the lists of all bands, which already joins large groups of near copies at a few pairs a member; the second verifies what is still apart, all
    pairs of an entry that is not crowded and the :func:`crowd_pairs` of all texts of crowded ones.
    """
    def with_root(frame: DataFrame, roots: DataFrame) -> DataFrame:
        roots = roots.withColumnRenamed("node", "_node")
        return frame.join(roots, F.col("node") == F.col("_node"), "left").select(*frame.columns, F.coalesce("root", "node").alias("root"))

    prints = materialize(simhash_pairs(nodes), "simhash_pairs")
    shared = materialize(shared_entries(nodes), "shared")
    named = shared.select("node").union(prints.select("a")).union(prints.select("b")).distinct()
    wanted = nodes.join(named, "node", "left_semi").select("node", F.col("first._id").alias("_i"), F.col("first._digest").alias("_d"))
    texts = rows.join(wanted.hint("merge"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_digest") == F.col("_d")))
    sets = hash_sets(texts, words).groupBy("node").agg(F.first("hashes").alias("hashes"))
    sets = materialize(sets, "sets")
    near = materialize(neighbours(grouped(shared.withColumn("root", F.col("node")))).union(prints).distinct(), "neighbours")
    links = materialize(verified(near, sets), "near_links")
    roots = connected_components(links)
    apart = strangers(grouped(with_root(shared.filter(F.col("n") <= GROUP), roots)))
    crowd = with_root(shared.filter(F.col("n") > GROUP).select("node").distinct(), roots)
    crowded = materialize(crowd.join(sets, "node"), "crowd")
    if not crowded.isEmpty():
        apart = apart.union(crowd_pairs(crowded)).distinct()
    apart = materialize(apart.join(near, ["a", "b"], "left_anti"), "strangers")
    return with_root(nodes, connected_components(links.union(materialize(verified(apart, sets), "far_links"))))


def keep_one(posts: DataFrame, words: int = WORDS) -> DataFrame:
    """One physical row of every group of near copies, all columns: the smallest id, a null id last, then the smallest digest of the content."""
    carried = Carried(posts)
    own = carried.frame.withColumns({"_id": carried["post_id"], "_digest": text_digest(carried["content"])})
    rows = own.select("_id", "_digest", carried["content"].alias("content"))
    written = materialize(signatures(rows, words), "signatures")
    keys = written.groupBy("alike", "_id", "_digest").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("bands", "fingerprint")])
    name = F.struct(F.col("_id").isNull().alias("unnamed"), "_id", "_digest", "n")
    # contents with one set have the same bands and fingerprint
    sets = keys.groupBy("alike").agg(F.min(name).alias("first"), *[F.first(c).alias(c) for c in ("bands", "fingerprint")])
    nodes = materialize(sets.select(F.monotonically_increasing_id().alias("node"), "first", "bands", "fingerprint"), "nodes")
    stays = rooted(nodes, rows, words).groupBy("root").agg(F.min("first").alias("first")).select("first._id", "first._digest", "first.n")
    return carried.restore(one_of_each(own, materialize(stays, "stays")), [])
