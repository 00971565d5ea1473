"""Ranked search of posts for texts, over an index stratified by length.

The score of a post sums over the terms of a text, repeats included, the term's weight times its impact
``(1000000000 * tf) div (1000 * tf + 12 * m)``; ``m``, the normaliser, depends on the post's length alone.  The index
holds posts of one ``m`` together: a stratum, cut into blocks of bounded size.  In a block the postings of a term
stand by falling ``tf``, so an impact is computed once for each ``tf`` there is.  The first posting of a term bounds what the term can add in the
stratum.  The strata with the highest bounds are visited first; the score of the last place there then rules out strata, and
blocks, that cannot reach it.  Nothing else is left out, so the result is exact.

Terms are the longest runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case.

Edge cases: a null or empty content, or one without terms, is in no stratum and never found; a query without terms, or whose terms no post
holds, finds nothing; every row of a table is a post or a query of its own, so repeated ones are found, or answered, as often as they
occur; equal scores go by ascending ``post_id``, a null id last; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsieve.session import materialize, scratch_path

#: Postings of one block of a stratum, one row of the index; a longer post is a block of its own.  Rows and row groups are small, so
#: that a reader never holds much: Spark's Parquet reader takes thousands of rows of a row group at once.
POSTINGS, ROW_GROUP = 1 << 13, 4 << 20
#: Bytes of texts whose terms are counted together.
TEXT_BYTES = 4 << 20
#: Postings of a stratum that are scored together.
SCORED = 1 << 17
#: Queries, and their distinct terms, of one block of queries on average: what is sent to every worker.
QUERIES, QUERY_TERMS = 1_000, 1 << 18
#: Posts in the strata that are visited first, for each query.
FIRST_POSTS = 512
#: Bytes that are part of no term become blanks, capitals become small letters.
FOLD = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()


def folded(texts: pa.Array) -> pa.Array:
    """The terms of every text with blanks between; the buffer is folded as a whole."""
    texts = pa.concat_arrays([texts])  # of a slice, its own part of the buffers
    valid, offsets, data = texts.buffers()
    return pa.Array.from_buffers(texts.type, len(texts), [valid, offsets, pa.py_buffer((data or pa.py_buffer(b"")).to_pybytes().translate(FOLD))], offset=texts.offset)


def counted(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Place of the text, term and how often it occurs there, for all terms of all texts, in the order of places."""
    split = pc.ascii_split_whitespace(folded(texts).fill_null(""))
    place = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    coded = split.flatten().dictionary_encode()
    some = pc.not_equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    n = max(1, len(some))
    pairs, tfs = np.unique((place.astype(np.int64) * n + codes)[some[codes]] if len(codes) else np.zeros(0, np.int64), return_counts=True)
    return pairs // n, coded.dictionary.cast(pa.binary()).take(pa.array(pairs % n)), tfs


def slices_of(batches: Iterator[pa.RecordBatch], texts: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``TEXT_BYTES`` in column ``texts``; a longer text is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def term_counts(rows: DataFrame, key: str) -> DataFrame:
    """``key``, ``n`` (terms with repeats), ``terms`` and their ``tfs`` for every ``content`` that has a term; map only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, 1):
            place, terms, tfs = counted(batch.column(1))
            some, starts = np.unique(place, return_index=True)
            ends = pa.array(np.append(starts, len(place)).astype(np.int32))
            n = np.add.reduceat(tfs, starts) if len(starts) else tfs
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(some)), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(ends, terms),
                pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int32)))], names=[key, "n", "terms", "tfs"])

    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL("n bigint, terms array<binary>, tfs array<int>")])
    return rows.select(key, F.col("content").cast("string").alias("content")).mapInArrow(count, schema)


def _written(frame: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder in small row groups, well packed: terms and postings take about as much as the texts."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.options(compression="zstd", **{"parquet.block.size": ROW_GROUP}).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@dataclass
class PostIndex:
    """``blocks``: one row for each with ``m``, ``post_ids``, ``terms`` and, per term, where its postings start in ``tfs`` and ``places``."""

    blocks: DataFrame
    n_posts: int
    n_terms: int


def _block(m: int, parts: list[pa.RecordBatch], names: list[str]) -> pa.RecordBatch:
    """The block of some posts of one stratum: postings by term, then by falling ``tf``, then by place."""
    table = pa.Table.from_batches(parts).combine_chunks()
    ids, terms, tfs = (table.column(name).combine_chunks() for name in ("post_id", "terms", "tfs"))
    sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
    coded = terms.flatten().dictionary_encode()
    codes, tf = coded.indices.to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)
    places = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    order = np.lexsort((places, -tf, codes))
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))[:-1]]).astype(np.int32)

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.RecordBatch.from_arrays(
        [pa.array([m], pa.int64()), one(ids), one(coded.dictionary), one(pa.array(starts)), one(pa.array(tf[order])), one(pa.array(places[order]))], names=names)


def build_index(posts: DataFrame, postings: int = POSTINGS) -> PostIndex:
    """The index of all ``posts`` (``post_id``, ``content``), written to the shared folder.

    Texts are read once.  The term counts of a post then travel once, to where its stratum is: ranges of ``m``, split anywhere by a
    scatter of rows, so a stratum with most of the posts is spread over many tasks.
    """
    counted = _written(term_counts(posts, "post_id"), "term_counts")
    n_posts, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.lit(100 - 25) + F.expr(f"(cast(25 * n as decimal(20, 0)) * cast({n_posts} as decimal(18, 0))) div {max(1, n_terms)}")
    placed = counted.select(m.cast("long").alias("m"), F.xxhash64(F.monotonically_increasing_id()).alias("_tie"), "post_id", "terms", "tfs")
    dealt = placed.repartitionByRange("m", "_tie").sortWithinPartitions("m", "_tie").drop("_tie")
    names = ["m", "post_ids", "terms", "starts", "tfs", "places"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, volume = None, [], 0
        for batch in batches:
            values = batch.column(0).to_numpy()
            ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(values):
                # as many posts of one stratum as there is room for, one at least
                before = ends[start - 1] if start else 0
                stop = min(np.searchsorted(values, values[start], "right"), np.searchsorted(ends, before + postings - volume, "right"))
                if parts and (values[start] != current or stop <= start):
                    yield _block(current, parts, names)
                    parts, volume = [], 0
                    continue
                current, stop = int(values[start]), max(start + 1, stop)
                parts.append(batch.slice(start, stop - start))
                volume += int(ends[stop - 1] - before)
                start = stop
        if parts:
            yield _block(current, parts, names)

    kind = posts.schema["post_id"].dataType
    schema = T.StructType([T.StructField("m", T.LongType()), T.StructField("post_ids", T.ArrayType(kind)), *T.StructType.fromDDL(
        "terms array<binary>, starts array<int>, tfs array<int>, places array<int>")])
    return PostIndex(_written(dealt.mapInArrow(blocks, schema), "post_index"), n_posts, n_terms)


def stratum_heads(index: PostIndex, wanted: DataFrame) -> DataFrame:
    """``m``, ``term``, ``df`` (posts of the stratum that hold it) and ``top`` (its highest ``tf`` there) for the ``wanted`` terms."""
    ends = F.concat(F.expr("slice(starts, 2, size(starts))"), F.array(F.size("tfs")))
    heads = index.blocks.select("m", F.explode(F.arrays_zip(
        F.col("terms").alias("term"), F.transform(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b")), lambda x: x["b"] - x["a"]).alias("df"),
        F.transform("starts", lambda at: F.get("tfs", at)).alias("top"))).alias("head")).select("m", "head.*")
    # the wanted terms are at most those of one block of queries, about QUERY_TERMS
    return heads.join(F.broadcast(wanted), "term", "left_semi").groupBy("m", "term").agg(F.sum("df").alias("df"), F.max("top").alias("top"))


def weight(n_posts: int, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_posts + 2)) / (2 * df + 1).cast("double")))


@dataclass
class QueryBlock:
    """Queries sent to the workers: ``query`` numbers, rising, with the places of their terms in ``terms`` and the summed weights."""

    query: np.ndarray
    terms: pa.Array
    starts: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(rows: list) -> QueryBlock:
        """From rows of ``query``, ``term``, ``weight``, ordered by query."""
        queries, sizes = np.unique(np.array([r["query"] for r in rows], np.int64), return_counts=True)
        coded = pa.array([bytes(r["term"]) for r in rows], pa.binary()).dictionary_encode()
        return QueryBlock(queries, coded.dictionary, np.concatenate([[0], np.cumsum(sizes)]), coded.indices.to_numpy(), np.array([r["weight"] for r in rows], np.int64))


def _best(scores: np.ndarray, ids: list, k: int) -> list[tuple]:
    """The ``k`` first (score, id), equal scores by id, a null id last."""
    found = sorted(zip((-scores).tolist(), ids), key=lambda x: (x[0], x[1] is None, x[1] if x[1] is not None else 0))
    return [(-s, i) for s, i in found[:k]]


@dataclass
class Unit:
    """Blocks of one stratum put together: the postings of the queries' terms, ordered by term, with their impacts."""

    m: int
    ids: list[pa.Array]
    term: np.ndarray
    place: np.ndarray
    impact: np.ndarray


def _units(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[Unit]:
    """The blocks as they come, those of one stratum in units of about ``SCORED`` postings."""
    m, ids, n_posts, found, volume = None, [], 0, [], 0

    def unit() -> Unit:
        term, place, tf = (np.concatenate([f[k] for f in found]) for k in range(3))
        order = np.argsort(term, kind="stable")
        # the impact of every tf is computed once
        kinds, which = np.unique(tf[order], return_inverse=True)
        impacts = (1_000_000_000 * kinds.astype(np.int64)) // (1000 * kinds.astype(np.int64) + 12 * m)
        return Unit(m, ids, term[order], place[order], impacts[which])

    for batch in batches:
        for row in range(batch.num_rows):
            here, columns = batch.column(0)[row].as_py(), [batch.column(c)[row].values for c in range(1, 6)]
            if found and (here != m or volume >= SCORED):
                yield unit()
                ids, n_posts, found, volume = [], 0, [], 0
            m = here
            starts, tfs, places = (c.to_numpy(zero_copy_only=False) for c in columns[2:])
            known = pc.index_in(columns[1], terms)
            lengths = np.where(known.is_valid().to_numpy(zero_copy_only=False), np.diff(np.append(starts, len(tfs))), 0)
            term = np.repeat(known.fill_null(0).to_numpy(zero_copy_only=False), lengths)
            postings = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            found.append((term, places[postings].astype(np.int64) + n_posts, tfs[postings]))
            ids.append(columns[0])
            n_posts, volume = n_posts + len(columns[0]), volume + len(term)
    if found:
        yield unit()


def _visit(batches: Iterator[pa.RecordBatch], block: QueryBlock, floors: np.ndarray, only: dict[int, set] | None, done: dict[int, set], k: int) -> dict[int, list]:
    """The best posts per query in some blocks of the index.

    ``floors`` has the score per query that a post must reach; it rises with what is found.  ``only`` names the queries that visit a
    stratum, ``done`` those that have been there.
    """
    best: dict[int, list] = {}
    floors = floors.copy()
    for unit in _units(batches, block.terms):
        first = np.searchsorted(unit.term, np.arange(len(block.terms) + 1))
        top = np.zeros(len(block.terms), np.int64)
        some = first[1:] > first[:-1]
        if not some.any():
            continue
        top[some] = np.maximum.reduceat(unit.impact, first[:-1][some])
        bounds = np.add.reduceat(top[block.term] * block.weight, block.starts[:-1])
        n_posts, ids, skip = sum(map(len, unit.ids)), None, done.get(unit.m, ())
        for q in np.flatnonzero((bounds > 0) & (bounds >= floors)).tolist():
            if q in skip or only is not None and q not in only.get(unit.m, ()):
                continue
            own = slice(block.starts[q], block.starts[q + 1])
            term, times = block.term[own], block.weight[own]
            lengths = first[term + 1] - first[term]
            postings = np.repeat(first[term] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            scores = np.zeros(n_posts, np.int64)
            np.add.at(scores, unit.place[postings], np.repeat(times, lengths) * unit.impact[postings])
            found = np.flatnonzero(scores >= max(1, floors[q]))
            if len(found) > k:
                found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k]]
            if len(found):
                ids, known = ids or [i for part in unit.ids for i in part.to_pylist()], best.get(q, [])
                merged = np.concatenate([scores[found], np.array([s for s, _ in known], np.int64)])
                best[q] = _best(merged, [*(ids[j] for j in found), *(i for _, i in known)], k)
                if len(best[q]) == k:
                    floors[q] = max(floors[q], best[q][-1][0])
    return best


def _visited(blocks: DataFrame, block: QueryBlock, floors: np.ndarray, only: dict | None, done: dict, k: int) -> DataFrame:
    """``query``, ``score``, ``post_id``: at most ``k`` rows of each query from every task."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((block, floors, only, done))
    kind = blocks.schema["post_ids"].dataType.elementType
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("score", T.LongType()), T.StructField("post_id", kind)])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, floors, only, done = shared.value
        id_type, found = None, {}

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(1).type.value_type
                yield batch

        found = _visit(seen(), block, floors, only, done, k)
        if id_type is not None:
            rows = [(int(block.query[q]), s, i) for q, best in found.items() for s, i in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], id_type)], names=["query", "score", "post_id"])

    return blocks.select("m", "post_ids", "terms", "starts", "tfs", "places").mapInArrow(visit, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """``rank`` from 1; the first ``k`` of every query, cut in each task before the shuffle and after it."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("post_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _answer(index: PostIndex, own: DataFrame, k: int) -> DataFrame | None:
    """``query``, ``rank``, ``score``, ``post_id`` for one block of queries; ``own`` has ``query``, ``term``, ``times``."""
    heads = materialize(stratum_heads(index, own.select("term").distinct()), "heads")
    known = own.join(heads.groupBy("term").agg(F.sum("df").alias("df")), "term")
    weighted = materialize(known.select("query", "term", (F.col("times") * weight(index.n_posts, F.col("df"))).cast("long").alias("weight")).filter("weight > 0"), "weights")
    rows = weighted.orderBy("query", "term").collect()  # about QUERY_TERMS
    if not rows:
        return None
    block = QueryBlock.of(rows)
    place = {int(q): j for j, q in enumerate(block.query)}
    # what a stratum can give at most, per query, and how many of its posts hold the most frequent of its terms
    bounds = materialize(weighted.join(heads, "term").groupBy("query", "m").agg(
        F.sum(F.col("weight") * F.expr("(1000000000L * top) div (1000L * top + 12L * m)")).alias("bound"), F.max("df").alias("posts")), "bounds")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "m")
    ordered = bounds.withColumn("before", F.coalesce(F.sum("posts").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = ordered.filter(F.col("before") < FIRST_POSTS).select("query", "m").collect()  # at most FIRST_POSTS for each query of the block
    done: dict[int, set] = {}
    for r in first:
        done.setdefault(r["m"], set()).add(place[r["query"]])
    spark, none = own.sparkSession, np.zeros(len(block.query), np.int64)
    strata = spark.createDataFrame([(m,) for m in done], "m long")
    near = materialize(_visited(index.blocks.filter(F.col("m").between(min(done), max(done))).join(F.broadcast(strata), "m", "left_semi"), block, none, done, {}, k), "near")
    last = _ranked(near, k).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") == k)
    floors, reached = none.copy(), materialize(last.select("query", "score"), "floors")
    for r in reached.collect():
        floors[place[r["query"]]] = r["score"]
    alive = bounds.join(reached, "query", "left").filter(F.col("bound") >= F.coalesce("score", F.lit(1))).select("m").distinct()
    far = materialize(_visited(index.blocks.join(materialize(alive, "strata"), "m", "left_semi"), block, floors, None, done, k), "far")
    return _ranked(near.union(far), k)


def search_posts(index: PostIndex, queries: DataFrame, k: int = 20, n_queries: int = QUERIES, query_terms: int = QUERY_TERMS) -> DataFrame:
    """``query_id``, ``rank``, ``post_id``, ``score``: the ``k`` best posts for each row of ``queries`` (``query_id``, ``content``).

    Queries are dealt into blocks by their number and that of their terms; a block meets the index in two passes, the second over the
    strata that the first has not ruled out.  From a task come at most ``k`` rows of a query.
    """
    rows = queries.select(F.struct(F.monotonically_increasing_id().alias("query"), "query_id").alias("own"), "content")
    counted = materialize(term_counts(rows, "own"), "queries")
    n, terms = counted.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-n // n_queries), -(-terms // query_terms))
    pairs = counted.select("own.query", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("times"))).alias("pair")).select("query", "pair.*")
    answers = [_answer(index, pairs.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b), k) for b in range(blocks)]
    found = [materialize(answer, "answers") for answer in answers if answer is not None]
    names = counted.select("own.*")
    if not found:
        kind = index.blocks.schema["post_ids"].dataType.elementType
        return names.limit(0).select("query_id", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("post_id"), F.lit(0).cast("long").alias("score"))
    every = functools.reduce(DataFrame.union, found)
    return names.join(every, "query").select("query_id", "rank", "post_id", "score")


def rank_posts(posts: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """:func:`search_posts` over an index of all ``posts``."""
    return search_posts(build_index(posts), queries, k)
