"""Hard negatives of posts for training an embedding: posts of another label that score just below an anchor's positives.

The project's records hold no embeddings, so the operator is general: posts with a ``vector`` of any origin, TF-IDF weights for instance,
and a ``label`` such as the class of the decision.

A component counts as ``floor(scale * x)``, so scores are integers and exact.  The positives of an anchor are its first other posts of
the same label, higher scores first, equal ones by ``post_id``.  Each positive opens a window of scores, a share of its own, and takes the first
posts of other labels in it.

Pairs are scored in blocks: some thousand anchors go to every task, which scores its posts against them and sends only those that can be among
the first: the positives, and, once these are settled, the first negatives of every window.  The scores are then shuffled by
anchor and sorted by (anchor, falling score, post), and a streaming iterator reads them: a positive opens its window, negatives are handed to
the open windows.  Nothing of an anchor is held but its open windows.

Edge cases: posts with a null label, a null vector, or a null or non-finite component take no part; an anchor without positives, or
without a post in a window, has no rows; a missing component of a shorter vector is 0; a negative or zero score of a positive leaves no window but
0 for 0; rows repeated with one id are posts of their own, as anchors too; a null id comes last; scores beyond 64 bits are the nearest
of 64 bits; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsieve.llm.order import with_row_numbers
from modsieve.session import materialize

#: Components of the anchors sent to the tasks at once, and the scores a task computes at once.
ANCHOR_VALUES, SCORES = 1 << 21, 1 << 20
LEAST, MOST = -(2**63) + 1, 2**63 - 1


def prepared(posts: DataFrame, scale: int) -> DataFrame:
    """``row`` (numbers in the order of ``post_id``), ``post_id``, ``label``, ``values`` and ``is_anchor`` of the posts that take part."""
    vector = F.col("vector").cast("array<double>")
    whole = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    used = posts.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & whole)
    rows = used.select(
        F.col("post_id").isNull().alias("_unnamed"), F.col("post_id"), F.col("label").cast("string").alias("label"),
        F.transform(vector, lambda x: F.floor(x * scale)).alias("values"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))
    return materialize(with_row_numbers(rows, ["_unnamed", "post_id"], "row").drop("_unnamed"), "vectors")


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` integers; shorter ones are filled with 0, longer ones cut, since what they are multiplied with ends there."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k, size in enumerate(np.minimum(sizes, width)):
        out[k, :size] = values[at[k] : at[k] + size]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` and ``b``, exact: in floating point or 64 bits where these are."""
    span = lambda x: max(float(x.max(initial=0)), -float(x.min(initial=0)))
    most = span(a) * span(b) * max(1, a.shape[1]) * 1.01
    if most < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < MOST:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), LEAST, MOST).astype(np.int64)


@dataclass
class Anchors:
    """One block of anchors; ``windows`` has for each the lower and upper ends, none where the upper is the lower."""

    row: np.ndarray
    post_id: pa.Array
    label: np.ndarray
    values: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _first(anchor: np.ndarray, score: np.ndarray, row: np.ndarray, place: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The first ``most`` of every anchor: falling score, then row."""
    order = np.lexsort((row, -score, anchor))
    anchor, score, row, place = anchor[order], score[order], row[order], place[order]
    starts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
    rank = np.arange(len(anchor)) - np.repeat(starts, np.diff(np.append(starts, len(anchor))))
    keep = rank < most
    return anchor[keep], score[keep], row[keep], place[keep]


class _Best:
    """The first ``most`` posts of every anchor so far, with their ids."""

    def __init__(self, n: int, most: int):
        self.most, self.floor = most, np.full(n, LEAST, np.int64)
        self.anchor, self.score, self.row, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def add(self, scores: np.ndarray, fits: np.ndarray, row: np.ndarray, ids: pa.Array) -> None:
        """``fits`` marks the posts (columns) of each anchor (rows of ``scores``) that count."""
        masked = np.where(fits, scores, LEAST)
        if masked.shape[1] > self.most:
            last = np.partition(masked, masked.shape[1] - self.most, axis=1)[:, masked.shape[1] - self.most]
            fits = fits & (masked >= np.maximum(last, self.floor)[:, None])
        anchor, place = np.nonzero(fits)
        if not len(anchor):
            return
        anchor, score, own, place = _first(anchor, scores[anchor, place], row[place], place, self.most)
        known = len(self.anchor)
        every = ids.take(pa.array(place)) if self.ids is None else pa.concat_arrays([self.ids, ids.take(pa.array(place))])
        self.anchor, self.score, self.row, kept = _first(
            np.append(self.anchor, anchor), np.append(self.score, score), np.append(self.row, own), np.arange(known + len(anchor)), self.most)
        self.ids = every.take(pa.array(kept))
        counts = np.bincount(self.anchor, minlength=len(self.floor))
        full = counts == self.most
        ends = np.cumsum(counts) - 1
        self.floor[full] = self.score[ends[full]]


def _scored(rows: DataFrame, anchors: Anchors, most: int, kind: int) -> DataFrame:
    """Of every task, the first ``most`` posts of each anchor (``kind`` 0: of its label; 1: of others, in each window)."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)
    id_type = rows.schema["post_id"].dataType
    names = ["anchor", "anchor_id", "score", "kind", "row", "post_id"]
    schema = T.StructType([T.StructField(n, id_type if n.endswith("_id") else T.LongType()) for n in names])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        windows = 1 if kind == 0 else anchors.low.shape[1]
        best = [_Best(len(anchors.row), most) for _ in range(windows)]
        codes = {label: k for k, label in enumerate(dict.fromkeys(anchors.label.tolist()))}
        own = np.array([codes[label] for label in anchors.label.tolist()])
        step = max(1, SCORES // max(1, len(anchors.row)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                row, ids = part.column(0).to_numpy(), part.column(1)
                label = np.array([codes.get(x, -1) for x in part.column(2).to_pylist()])
                found = products(anchors.values, matrix(part.column(3), anchors.values.shape[1]))
                same = own[:, None] == label[None, :]
                if kind == 0:
                    best[0].add(found, same & (anchors.row[:, None] != row[None, :]), row, ids)
                for w in range(windows if kind else 0):
                    best[w].add(found, ~same & (found >= anchors.low[:, w, None]) & (found <= anchors.high[:, w, None]), row, ids)
        for b in best:
            if b.ids is not None:
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchors.row[b.anchor]), anchors.post_id.take(pa.array(b.anchor)), pa.array(b.score), pa.array(np.full(len(b.anchor), kind)),
                    pa.array(b.row), b.ids], names=names)

    return rows.select("row", "post_id", "label", "values").mapInArrow(score, schema)


def result_schema(id_type: T.DataType) -> T.StructType:
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return T.StructType([T.StructField(n, id_type if n.endswith("_id") else T.IntegerType() if n == "rank" else T.LongType()) for n in names])


def open_windows(pairs: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """Hand negatives to the windows of positives: ``pairs`` by anchor, positives and negatives in falling order of scores."""
    schema = result_schema(pairs.schema["post_id"].dataType)
    names = schema.names

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows, last = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for key, owner, score, kind, row, post in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if key != anchor:
                    anchor, windows, last = key, [], None
                if kind == 0:
                    windows.append([score, post, 0])
                elif row != last:
                    # a post comes once for every window it may be in
                    last = row
                    for window in windows:
                        if window[2] < negatives and low * window[0] <= 100 * score <= high * window[0]:
                            window[2] += 1
                            out.append((owner, window[1], window[2], post, window[0], score))
            kind_of_id = batch.schema.field(5).type
            types = [kind_of_id, kind_of_id, pa.int32(), kind_of_id, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    placed = pairs.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "kind", "row")
    return placed.mapInArrow(stream, schema)


def mine_hard_negatives(posts: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``posts`` has ``post_id``, ``label``, ``vector`` and ``is_anchor``.  A negative's score is between ``low`` and ``high`` hundredths of the
    positive's.  Each positive has its first ``negatives``, ranked from 1.

    Anchors are taken in blocks of ``ANCHOR_VALUES`` components; a block meets all posts twice, map only, and from a task come at most
    ``positives * (1 + negatives)`` rows of an anchor.
    """
    rows = prepared(posts, scale)
    anchors = rows.filter("is_anchor")
    volume, width = anchors.agg(F.coalesce(F.sum(F.size("values") + 1), F.lit(0)), F.coalesce(F.max(F.size("values")), F.lit(0))).first()
    blocks = max(1, -(-volume // ANCHOR_VALUES))
    found = []
    for b in range(blocks):
        table = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").select("row", "post_id", "label", "values").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        column = lambda name: table.column(name).combine_chunks()  # noqa: B023, E731
        block = Anchors(column("row").to_numpy(), column("post_id"), np.array(column("label").to_pylist(), object), matrix(column("values"), width))
        order = Window.partitionBy("anchor").orderBy(F.desc("score"), "row")
        first = _scored(rows, block, positives, 0).withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= positives)
        near = materialize(first, "positives")
        # at most ``positives`` rows of every anchor of the block
        settled = near.select("anchor", "_place", "score").collect()
        place = {int(row): k for k, row in enumerate(block.row)}
        block.low, block.high = np.full((len(place), positives), MOST), np.full((len(place), positives), LEAST)
        for r in settled:
            at = place[r["anchor"]], r["_place"] - 1
            block.low[at], block.high[at] = max(LEAST, -(-low * r["score"] // 100)), high * r["score"] // 100
        far = _scored(rows, block, negatives, 1)
        found.append(materialize(open_windows(near.drop("_place").union(far), negatives, low, high), "hard_negatives"))
    if not found:
        return posts.sparkSession.createDataFrame([], result_schema(posts.schema["post_id"].dataType))
    return functools.reduce(DataFrame.union, found)
