"""Index join of posts with keyword tables of any size.

A hit has the letters of its keyword in order, neighbours at most ``REACH`` positions apart.  So it also has every run of neighbouring letters
of the keyword that way.  Each keyword is filed under one such run, ``PART`` letters from where they are rarest (a shorter keyword is its own run);
posts and keywords meet in an equi-join on a number of that run, and the keyword's own pattern decides in the squashed post.

One pass over the posts looks for the runs, letter by letter: for each length, ``CELLS`` bits tell whether a run can begin with these letters, however many
keywords there are, so few places are left after some letters.  A wrong yes of a bit costs a candidate and no hit.  No plan holds a keyword.  A
run that many posts have is split: its keywords are repeated once for every ``POSTS_A_SHARE`` posts and a post takes the share a hash of its id names, so
no task gets all of them.  Contents take part in one join, with the candidates, on ``post_id``.

Posts that share an id, or have none, keep their hits each; a null content has none; keywords without letters or digits are
left out; repeated keyword rows hit once each; an empty table of either kind gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modsieve.functions.text import squash
from modsieve.operators.lexicon import rare_part
from modsieve.session import materialize, share_package

LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"
GRAM = 4
#: A letter's neighbour in a hit is at most so many positions on: two foreign characters between.
REACH = 3
BASE = len(LETTERS) + 1
KEYS = BASE ** GRAM
#: Letters of a run.
PART = 20
#: Bits for each length of a run, and of the numbers of runs; factors that spread the numbers of letters over 64 bits.
CELLS, NAME_BITS, STEP, SPREAD = 1 << 19, 44, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
POSTS_A_SHARE = 100_000
#: Characters looked through at once, texts taken together up to so many, and finds merged beyond so many: bounds of a worker's memory.
CHUNK, TOGETHER, MOST_FOUND = 65_536, 262_144, 2_000_000

_RANK = np.zeros(256, np.int32)
_RANK[list(LETTERS.encode())] = np.arange(1, BASE)


class Grams:
    """A set of grams as numbers (the rank of each letter is one digit to ``BASE``, the first letter the lowest), from its bits."""

    letters, names = GRAM, KEYS

    def __init__(self, bits: bytes):
        self.wanted = np.unpackbits(np.frombuffer(bits, np.uint8), count=KEYS).astype(bool)
        numbers = np.flatnonzero(self.wanted)
        #: by length: whether a wanted gram begins with these letters
        self.begins = [np.zeros(BASE ** size, bool) for size in range(GRAM + 1)]
        for size in range(1, GRAM + 1):
            self.begins[size][numbers[numbers >= BASE ** (size - 1)] % BASE ** size] = True

    @staticmethod
    def bits_of(numbers: np.ndarray) -> bytes:
        wanted = np.zeros(KEYS, bool)
        wanted[numbers] = True
        return np.packbits(wanted).tobytes()

    def held_in_parts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """:meth:`held_by` for a few texts after the other, positions in all ``texts``."""
        ends = np.cumsum([len(text or "") + REACH for text in texts])
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
            rows, found = self.held_by(texts[start:stop])
            yield rows + start, found
            start = stop

    def held_by(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each (position in ``texts``, wanted gram of that squashed text) once."""
        whole = [text or "" for text in texts]
        starts = np.cumsum([0] + [len(text) + REACH for text in whole[:-1]])
        # no gram reaches over a border of so many foreign characters
        ranks = _RANK[np.frombuffer(("\n" * REACH).join(whole).encode("ascii"), np.uint8)]
        found = [np.zeros(0, np.int64)]
        for start in range(0, len(ranks), CHUNK):
            part = ranks[start : start + CHUNK + REACH * (self.letters - 1)]
            at, number = self._first(part[:CHUNK])
            for size in range(1, self.letters + 1):
                hit, name = self._whole(number)
                row = np.searchsorted(starts, at[hit] + start, "right") - 1
                found.append(np.unique(row * self.names + name))
                if sum(map(len, found)) > MOST_FOUND:
                    found = [np.unique(np.concatenate(found))]
                if size < self.letters:
                    steps = [self._longer(part, at, number, step, size) for step in range(1, REACH + 1)]
                    at, number = self._once(*(np.concatenate(both) for both in zip(*steps)))
        return np.divmod(np.unique(np.concatenate(found)), self.names)

    def _first(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.begins[1][ranks]).astype(np.int32)
        return at, ranks[at]

    def _once(self, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return at, number

    def _whole(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = self.wanted[number]
        return hit, number[hit]

    def _longer(self, ranks: np.ndarray, at: np.ndarray, number: np.ndarray, step: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        inside = at + step < len(ranks)
        at, number = at[inside] + np.int32(step), number[inside]
        letter = ranks[at]
        number = number + letter * np.int32(BASE ** size)
        goes_on = (letter > 0) & self.begins[size + 1][number]
        return at[goes_on], number[goes_on]


class Runs(Grams):
    """A set of runs of up to ``PART`` letters: numbers of 64 bits that grow by a letter, looked up in bits by a hash."""

    letters, names = PART, 1 << NAME_BITS
    #: of all bits; row 0 is of whole runs, the others of their first letters
    shape = (PART + 1, CELLS)

    def __init__(self, bits: bytes):
        self.wanted, *self.begins = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool).reshape(self.shape)

    @staticmethod
    def numbers_of(run: str) -> np.ndarray:
        """Of the first letter, the first two and so on, to the whole run."""
        number, out = np.zeros(1, np.uint64), []
        for rank in _RANK[list(run.encode("ascii"))]:
            number = number * STEP + np.uint64(rank)
            out.append(number)
        return np.concatenate(out)

    @staticmethod
    def bits_of(runs: list[str]) -> bytes:
        bits = np.zeros(Runs.shape, bool)
        for run in runs:
            cells = Runs._cell(Runs.numbers_of(run))
            bits[0, cells[-1]] = True
            bits[np.arange(1, len(run) + 1), cells] = True
        return np.packbits(bits).tobytes()

    @staticmethod
    def name(number: np.ndarray) -> np.ndarray:
        return ((number * SPREAD) >> np.uint64(64 - NAME_BITS)).astype(np.int64)

    @staticmethod
    def _cell(number: np.ndarray) -> np.ndarray:
        return Runs.name(number) >> (NAME_BITS - CELLS.bit_length() + 1)

    def _first(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letters = np.array([r > 0 and self.begins[0][self._cell(np.array([r], np.uint64))[0]] for r in range(BASE)])
        at = np.flatnonzero(letters[ranks]).astype(np.int32)
        return at, ranks[at].astype(np.uint64)

    def _once(self, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each place once for the same letters: in a text that repeats a letter, ways to a place grow threefold with every letter."""
        order = np.lexsort((number, at))
        at, number = at[order], number[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (number[1:] != number[:-1])
        return at[new], number[new]

    def _whole(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = self.wanted[self._cell(number)]
        return hit, self.name(number[hit])

    def _longer(self, ranks: np.ndarray, at: np.ndarray, number: np.ndarray, step: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        inside = at + step < len(ranks)
        at, number = at[inside] + np.int32(step), number[inside]
        letter = ranks[at]
        number = number * STEP + letter.astype(np.uint64)
        goes_on = (letter > 0) & self.begins[size][self._cell(number)]
        return at[goes_on], number[goes_on]


def post_runs(posts: DataFrame, bits: bytes) -> DataFrame:
    """``post_id``, ``spot`` (a hash of it) and ``run`` for the wanted runs of every post; ``posts`` has ``squashed``."""
    kind = posts.schema["post_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(bits)
        for batch in batches:
            for rows, found in runs.held_in_parts(batch.column(2).to_pylist()):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found)], ["post_id", "spot", "run"])

    return posts.select("post_id", F.xxhash64("post_id").alias("spot"), "squashed").mapInArrow(of, f"post_id {kind}, spot long, run long")


def keyword_runs(table: DataFrame) -> DataFrame:
    """``row``, ``kw_idx``, ``keyword``, ``clean``, its rare ``letters`` and the number of that ``run``."""
    @F.pandas_udf("letters string, run long")
    def of(clean: pd.Series) -> pd.DataFrame:
        letters = [rare_part(c, PART) for c in clean]
        return pd.DataFrame({"letters": letters, "run": [int(Runs.name(Runs.numbers_of(x)[-1:])[0]) for x in letters]})

    named = table.select(F.monotonically_increasing_id().alias("row"), "kw_idx", "keyword", squash(F.col("keyword")).alias("clean")).filter("clean != ''")
    return named.withColumn("filed", of("clean")).select("row", "kw_idx", "keyword", "clean", "filed.*")


def run_bits(filed: DataFrame) -> bytes:
    """The bits of all ``letters``; a task sends one array of fixed size, and one comes to the driver."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = {x for batch in batches for x in batch.column(0).to_pylist()}
        if letters:
            yield pa.RecordBatch.from_arrays([pa.array([Runs.bits_of(letters)], pa.binary())], ["bits"])

    def either(x: bytes, y: bytes) -> bytes:
        return (np.frombuffer(x, np.uint8) | np.frombuffer(y, np.uint8)).tobytes()

    return filed.select("letters").mapInArrow(of, "bits binary").rdd.map(lambda row: bytes(row[0])).treeAggregate(Runs.bits_of([]), either, either)


def indexed_hits(posts: DataFrame, table: DataFrame) -> DataFrame:
    """One row ``(post_id, kw_idx, keyword)`` per post and row of ``table`` (``kw_idx``, ``keyword``) that hits."""
    share_package(posts.sparkSession)
    texts = posts.select("post_id", squash(F.col("content")).alias("squashed"))
    # numbered by a written table, so that a row has one number in every use
    filed = materialize(keyword_runs(materialize(table.select("kw_idx", "keyword"), "keywords")), "filed_keywords")
    held = materialize(post_runs(texts, run_bits(filed)), "post_runs")
    # a small table: one row for every POSTS_A_SHARE rows of held at most
    hot = F.broadcast(materialize(held.groupBy("run").agg(F.ceil(F.count("*") / POSTS_A_SHARE).alias("shares")).filter("shares > 1"), "hot_runs"))
    shares = F.coalesce("shares", F.lit(1).cast("long"))
    spread = filed.join(hot, "run", "left").select("row", "kw_idx", "keyword", "clean", "run", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))
    dealt = held.join(hot, "run", "left").select(F.col("post_id").alias("_id"), "run", F.pmod("spot", shares).alias("share"))
    candidates = dealt.join(spread, ["run", "share"]).select("_id", "row", "kw_idx", "keyword", "clean").dropDuplicates(["_id", "row"])
    pattern = F.regexp_replace("clean", "(?<=.)(?=.)", f".{{0,{REACH - 1}}}")
    met = candidates.join(texts, F.col("post_id").eqNullSafe(F.col("_id")))
    return met.filter(F.rlike("squashed", pattern)).select("post_id", "kw_idx", "keyword")
