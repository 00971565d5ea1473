"""Language of posts by prediction by partial matching.

Every language has a tree of byte contexts of up to three bytes with the bytes that followed them, counted once and
frozen.  A byte is coded in the longest context the tree has; a byte unseen there costs an escape and is coded in the
next shorter context, without the bytes the longer one would have coded.  The language with the shortest code for the
whole content wins.

Edge cases: a null content, or one without a letter, is ``und`` with score 0; one letter is enough for a decision; ties go
to the first language by name; repeated rows are scored alike; without any labelled post everything is ``und``; an
empty table gives an empty table; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modsieve.llm.carry import Carried
from modsieve.llm.samples import labelled_sample
from modsieve.session import materialize

UNDETERMINED = "und"
LETTER = r"\p{L}"
#: Bytes counted or scored at once; a longer content is taken part by part, its context carried on.
CHUNK = 1 << 20
#: Contexts kept of all languages together; few languages have ``contexts_per_language`` each.  An entry takes 8 bytes.
MOST_CONTEXTS = 1_000_000


@dataclass
class ContextTrees:
    """Frozen counts: row ``k`` says that ``byte`` followed ``context`` (of ``length`` bytes, as a number) ``count`` times in ``language``."""

    languages: list[str]
    order: int
    length: np.ndarray
    context: np.ndarray
    byte: np.ndarray
    language: np.ndarray
    count: np.ndarray


def groups_of(texts: list[bytes], order: int) -> Iterator[list[tuple[int, bytes]]]:
    """Pieces of the texts with the places of their texts, every piece after ``order`` bytes of context, blanks at the start.

    A group holds at most ``CHUNK`` bytes and a context, wherever a long text stands.
    """
    group: list[tuple[int, bytes]] = []
    volume = 0
    for k, text in enumerate(texts):
        for at in range(0, len(text), CHUNK):
            piece = text[at - order : at + CHUNK] if at else b" " * order + text[:CHUNK]
            if group and volume + len(piece) > CHUNK:
                yield group
                group, volume = [], 0
            group.append((k, piece))
            volume += len(piece)
    if group:
        yield group


def gram_codes(pieces: list[bytes], order: int) -> np.ndarray:
    """Every byte after the first ``order`` of each piece with the ``order`` bytes before it, as one number."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    codes = np.zeros(max(0, len(data) - order), np.uint32)
    for k in range(order + 1):
        codes = codes << np.uint32(8) | data[k : k + len(codes)]
    # what straddles two pieces is none of either
    inside = np.ones(len(codes), bool)
    ends = np.cumsum([len(p) for p in pieces])[:-1]
    for k in range(order):
        inside[ends - order + k] = False
    return codes[inside]


class Coder:
    """Code lengths in the trees of all languages.

    For every language and length of context there are sorted arrays: the grams seen, a context and the byte after it, with their code
    lengths, and the contexts seen with the length of their escapes.  Nothing is kept of what was not seen.
    """

    def __init__(self, trees: ContextTrees):
        self.languages, self.order = trees.languages, trees.order
        self.levels: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
        for k in range(len(trees.languages)):
            levels: list = []
            for length in range(trees.order + 1):
                here = (trees.language == k) & (trees.length == length)
                grams = (trees.context[here].astype(np.uint32) << np.uint32(8)) | trees.byte[here].astype(np.uint32)
                order = np.argsort(grams)
                grams, counts = grams[order], trees.count[here][order].astype(float)
                contexts, which = np.unique(grams >> np.uint32(8), return_inverse=True)
                total, kinds = np.bincount(which, counts), np.bincount(which)
                # what the shorter contexts give to the bytes seen here is left out of what they give to the others
                taken = np.bincount(which, np.exp2(-self._bits(levels, grams)))
                escape = kinds / (total + kinds) / np.maximum(1 - taken, 1e-12)
                levels.append((
                    grams, -np.log2(counts / (total + kinds)[which]).astype(np.float32), contexts.astype(np.uint32), -np.log2(escape).astype(np.float32)))
            self.levels.append(levels)

    @staticmethod
    def _bits(levels: list, grams: np.ndarray) -> np.ndarray:
        """Code lengths of the last bytes of ``grams`` after the longest contexts of ``levels``."""
        bits, left = np.zeros(len(grams)), np.arange(len(grams))
        for length in range(len(levels) - 1, -1, -1):
            seen, lengths, contexts, escapes = levels[length]
            if not len(seen):
                continue
            own = grams[left] & np.uint32((1 << 8 * (length + 1)) - 1)
            at = np.minimum(np.searchsorted(seen, own), len(seen) - 1)
            hit = seen[at] == own
            bits[left[hit]] += lengths[at[hit]]
            left, own = left[~hit], own[~hit] >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            bits[left] += np.where(contexts[at] == own, escapes[at], 0)
        bits[left] += 8
        return bits

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language; every gram of a group is looked up once."""
        out = np.zeros((len(texts), len(self.languages)))
        for group in groups_of(texts, self.order):
            places = np.array([k for k, _ in group])
            starts = np.cumsum([0, *(len(piece) - self.order for _, piece in group)])[:-1]
            grams, which = np.unique(gram_codes([piece for _, piece in group], self.order), return_inverse=True)
            for k, levels in enumerate(self.levels):
                np.add.at(out[:, k], places, np.add.reduceat(self._bits(levels, grams)[which], starts))
        return out


def learn_languages(posts: DataFrame, order: int = 3, rows_per_language: int = 2_000, contexts_per_language: int = 30_000) -> ContextTrees:
    """Context trees from labelled ``posts``: ``content`` and ``language``, rows without either are left out; ``order`` is 3 at most.

    The sample holds about ``rows_per_language`` different whole contents of each language.  Tasks count their part, Spark sums.
    Of every language the ``contexts_per_language`` most frequent contexts reach the driver, fewer if there are so many languages that they
    would be more than ``MOST_CONTEXTS``: some 8 MB of entries at most, about one for each language.  All languages are learned.
    A context is never more frequent than its suffixes, so pruning takes leaves first.
    """
    sample = labelled_sample(posts.select("content", F.col("language").cast("string").alias("language")), "language", rows_per_language)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for content, language in zip(batch.column(0), batch.column(1).to_pylist()):
                texts.setdefault(language, []).append(content.as_buffer().to_pybytes().lower())
            for language, own in texts.items():
                for group in groups_of(own, order):
                    values, counts = np.unique(gram_codes([piece for _, piece in group], order), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([language] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["language", "gram", "n"])

    counted = sample.select("content", "language").mapInArrow(grams, "language string, gram bigint, n bigint")
    longest = materialize(counted.groupBy("language", "gram").agg(F.sum("n").alias("n")), "grams")
    every = longest.withColumn("length", F.explode(F.sequence(F.lit(0), F.lit(order)))).groupBy(
        "language", "length", F.call_function("pmod", F.col("gram"), F.expr("shiftleft(1L, 8 * (length + 1))")).alias("gram")).agg(F.sum("n").alias("n"))
    every = materialize(every.withColumn("context", F.shiftright("gram", 8)), "contexts")
    names = sorted(r["language"] for r in every.select("language").distinct().collect())
    most = min(contexts_per_language, MOST_CONTEXTS // max(1, len(names)))
    frequent = Window.partitionBy("language").orderBy(F.desc("total"), "length", "context")
    kept = every.groupBy("language", "length", "context").agg(F.sum("n").alias("total")).withColumn("place", F.row_number().over(frequent)).filter(F.col("place") <= most)
    rows = every.join(kept.select("language", "length", "context"), ["language", "length", "context"]).select(
        "language", F.col("length").cast("long").alias("length"), "context", F.col("gram").bitwiseAND(255).alias("byte"), "n").toArrow()
    column = {name: rows.column(name).to_numpy() for name in ("length", "context", "byte", "n")}
    place = pc.index_in(rows.column("language"), pa.array(names, pa.string())).to_numpy()
    return ContextTrees(names, order, column["length"], column["context"], column["byte"], place, column["n"])


def predict_language(posts: DataFrame, trees: ContextTrees) -> DataFrame:
    """``posts`` with ``language_pred`` and ``language_score``; reads ``content`` alone, whole.

    The score is the probability of the best language, from the code lengths, if all learned ones are equally likely.
    Map only.  The model is made once, here, and broadcast; ``MOST_CONTEXTS`` bounds its size.
    """
    spark = posts.sparkSession
    if not trees.languages:
        return posts.withColumns({"language_pred": F.lit(UNDETERMINED), "language_score": F.lit(0.0)})
    shared = spark.sparkContext.broadcast(Coder(trees))

    @F.pandas_udf("language_pred string, language_score double")
    def score(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = shared.value
        names = np.array(coder.languages, object)
        for content in contents:
            bits = coder.lengths([b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in content])
            best = bits.argmin(axis=1) if len(bits) else np.zeros(0, int)
            likely = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1) if len(bits) else np.zeros(0)
            yield pd.DataFrame({"language_pred": names[best], "language_score": likely})

    carried = Carried(posts)
    content = carried["content"].cast("string")
    lettered = F.coalesce(content.rlike(LETTER), F.lit(False))
    scored = carried.frame.withColumn("_scored", score(content)).withColumn("_lettered", lettered)
    return carried.restore(scored.withColumns({
        "language_pred": F.when(F.col("_lettered"), F.col("_scored")["language_pred"]).otherwise(UNDETERMINED),
        "language_score": F.when(F.col("_lettered"), F.col("_scored")["language_score"]).otherwise(0.0)}), ["language_pred", "language_score"])
