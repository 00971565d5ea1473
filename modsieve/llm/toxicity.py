"""Toxic spans of posts, tagged by a linear-chain conditional random field over words.

Posts are labelled as wholes, the chain needs labelled words.  A word is labelled toxic if it stands in a toxic post and
has a sign of toxicity: the word, or a beginning of three to six letters, that many toxic posts have in many different
neighbourhoods and hardly any clean one has.  Copies of one post share their neighbourhoods and make no sign.

Edge cases: a null or empty content has no words, and the score of a text without a toxic word; contents of any length are
tagged whole; repeated rows are scored alike; without both labels every score is 0; an empty table gives an empty table;
other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsieve.llm import crf
from modsieve.llm.carry import Carried
from modsieve.llm.samples import labelled_sample
from modsieve.llm.vocabulary import Bounded
from modsieve.llm.workers import held
from modsieve.session import materialize

WORD = re.compile(r"[^\W\d_]+")
#: Words tagged at once; a longer content is a batch of its own.
BATCH_WORDS = 200_000
#: Words on either side of the middle of a training window.
REACH = 8
#: Windows taken from one sampled post at most, places drawn by a hash over all its words with a candidate sign: the chain is fitted on
#: windows, it tags whole contents.
WINDOWS = 12
#: Most frequent candidates for a sign that reach the driver.
MOST_SIGNS = 20_000
LEAST_ODDS = 1.8
#: What a score is made of: log odds of any toxic word, the largest marginal, and logarithms of one plus the sum of the
#: marginals, the number of words at one half or more, and the sum per hundred words.
EVIDENCE = ["odds", "largest", "total", "likely", "dense"]


@dataclass
class Tagger:
    """Word weights, transitions, and how marginals make a score."""

    weights: np.ndarray
    transitions: np.ndarray
    score_weights: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def lowered(content: str) -> str:
    """Lower case, character by character where that would change the length, so that offsets are those of the content."""
    whole = content.lower()
    return whole if len(whole) == len(content) else "".join(low if len(low := c.lower()) == 1 else c for c in content)


def words_of(content: str | None) -> list[str]:
    return WORD.findall(lowered(content)) if content else []


def signs_of(word: str) -> list[str]:
    return [f"={word}", *(f"{word[:k]}-" for k in range(3, 7) if len(word) >= k)]


class Scorer:
    """Tags batches of contents with one tagger; word scores are remembered."""

    def __init__(self, tagger: Tagger, memo: int = 400_000):
        self.tagger = tagger
        weights = tagger.weights
        self.scores = Bounded(lambda w: float(weights[crf.word_features(w)].sum()), memo)

    def tagged(self, contents: list[str | None]) -> Iterator[tuple[int, list[list[str]], np.ndarray, np.ndarray]]:
        """For runs of contents: position of the first, words, marginals of all words, log probability of no toxic word."""
        start, group, volume = 0, [], 0
        for k, content in enumerate(contents):
            group.append(words_of(content))
            volume += len(group[-1])
            if volume >= BATCH_WORDS or k == len(contents) - 1:
                sizes = np.array([len(w) for w in group], np.int64)
                scores = np.fromiter((s for words in group for s in map(self.scores.__getitem__, words)), np.float64, volume)
                chains = crf.Chains(scores, sizes, self.tagger.transitions)
                yield start, group, chains.marginals() if volume else np.zeros(0), chains.clean_log_probability()
                self.scores.trim()
                start, group, volume = k + 1, [], 0

    def evidence(self, contents: list[str | None]) -> np.ndarray:
        """:data:`EVIDENCE` of every content."""
        rows = [np.zeros((0, len(EVIDENCE)))]
        for _, group, marginals, clean in self.tagged(contents):
            sizes = np.array([len(w) for w in group])
            starts, full = np.cumsum(sizes) - sizes, sizes > 0
            largest, total, likely = np.zeros(len(group)), np.zeros(len(group)), np.zeros(len(group))
            if full.any():
                largest[full] = np.maximum.reduceat(marginals, starts[full])
                total[full] = np.add.reduceat(marginals, starts[full])
                likely[full] = np.add.reduceat((marginals >= 0.5).astype(float), starts[full])
            odds = np.log(np.maximum(-np.expm1(clean), 1e-12)) - np.maximum(clean, -30.0)
            rows.append(np.column_stack([odds, largest, np.log1p(total), np.log1p(likely), np.log1p(100 * total / np.maximum(sizes, 1))]))
        return np.concatenate(rows)

    def spans(self, contents: list[str | None], least: float) -> list[list[dict]]:
        """Runs of words with marginals of at least ``least``: first code point, length, largest marginal."""
        out: list[list[dict]] = []
        for start, group, marginals, _ in self.tagged(contents):
            at = 0
            for k, words in enumerate(group):
                own = marginals[at : at + len(words)]
                at += len(words)
                found: list[dict] = []
                if len(own) and own.max() >= least:
                    text = contents[start + k]
                    last = -2
                    for place, match in enumerate(WORD.finditer(lowered(text))):
                        if own[place] < least:
                            continue
                        if place == last + 1:
                            found[-1] |= {"length": match.end() - found[-1]["start"], "marginal": max(found[-1]["marginal"], float(own[place]))}
                        else:
                            found.append({"start": match.start(), "length": match.end() - match.start(), "marginal": float(own[place])})
                        last = place
                out.append(found)
        return out


def scorer_of(tagger: Tagger) -> Scorer:
    return held(("scorer", tagger.key), lambda: Scorer(tagger))


def _sign_counts(sample: DataFrame) -> DataFrame:
    """``sign``, ``toxic``, ``clean``: posts of the sample that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for content, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label].update({s for w in set(words_of(content)) for s in signs_of(w)})
            names = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([
                pa.array(names, pa.string()), pa.array([counts[1][s] for s in names], pa.int64()), pa.array([counts[0][s] for s in names], pa.int64()),
            ], names=["sign", "toxic", "clean"])

    part = sample.mapInArrow(count, "sign string, toxic bigint, clean bigint")
    return part.groupBy("sign").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _windows(sample: DataFrame, signs: set[str]) -> DataFrame:
    """``label``, ``words``, ``middle``, ``signs``: windows around words with a candidate sign, and one at a fixed random place."""
    shared = sample.sparkSession.sparkContext.broadcast(signs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for content, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(content)
                if not words:
                    continue
                hits = [(k, found) for k, w in enumerate(words) if (found := [s for s in signs_of(w) if s in known])]
                fixed = int.from_bytes(content.encode("utf-8", "surrogatepass")[-8:], "little") % len(words)
                hits.sort(key=lambda hit: zlib.crc32(f"{hit[0]} {words[hit[0]]}".encode("utf-8", "surrogatepass")))
                for k, found in [*sorted(hits[: WINDOWS - 1]), (fixed, [])]:
                    rows.append((label, words[max(0, k - REACH) : k + REACH + 1], min(k, REACH), found))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.string())),
                pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.list_(pa.string())),
            ], names=["label", "words", "middle", "signs"])

    return sample.mapInArrow(cut, "label int, words array<string>, middle int, signs array<string>")


def learn_toxicity(posts: DataFrame, labels: DataFrame, rows_per_label: int = 2_000) -> Tagger:
    """A tagger from ``posts`` (``post_id``, ``content``) and ``labels`` (``post_id``, ``toxic``: 0, 1 or null).

    About ``rows_per_label`` posts of each label are used, drawn from the labels alone by their ids, so that contents
    meet a table of that size and are not shuffled for it.  Of several labels of a post the larger one counts.
    The driver gets the most frequent signs, at most :data:`MOST_SIGNS`, at most :data:`WINDOWS` windows of a few
    words per sampled post, and five numbers per sampled post: all bounded by ``rows_per_label``.
    """
    labelled = labels.groupBy(F.col("post_id").alias("_key")).agg(F.max("toxic").cast("int").alias("label")).filter("label in (0, 1)")
    drawn = materialize(labelled_sample(labelled, "label", rows_per_label, key="_key"), "drawn")
    # about twice `rows_per_label` rows
    texts = posts.select("post_id", "content").join(F.broadcast(drawn), F.col("post_id") == F.col("_key"))
    sample = materialize(texts.select("content", "label").repartition(32), "labelled")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    nothing = Tagger(np.zeros(crf.WIDTH, np.float32), np.array([[0.0, -1.0], [0.0, 0.0]]), np.array([0.0] * len(EVIDENCE) + [-50.0]))
    if not n_toxic or not n_clean:
        return nothing
    least = max(3, math.ceil(0.02 * n_toxic))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    candidates = {r["sign"] for r in _sign_counts(sample).filter((F.col("toxic") >= least) & (odds >= LEAST_ODDS)).orderBy(
        F.desc("toxic"), "sign").limit(MOST_SIGNS).select("sign").collect()}
    windows = _windows(sample, candidates).toPandas()
    # a sign of toxicity stands in many neighbourhoods
    around: dict[str, set] = {}
    for label, words, middle, found in windows.itertuples(index=False):
        if label == 1:
            near = (words[middle - 1] if middle else "", words[middle + 1] if middle + 1 < len(words) else "")
            for sign in found:
                around.setdefault(sign, set()).add(near)
    signs = {s for s, places in around.items() if len(places) >= max(3, least // 2)}
    unique: dict[tuple, int] = {}
    for label, words, _, found in windows.itertuples(index=False):
        unique.setdefault((label, tuple(words)), 0)
    texts, labels = [], []
    for label, words in unique:
        texts.append(words)
        labels += [int(label == 1 and not signs.isdisjoint(signs_of(w))) for w in words]
    flat = [w for words in texts for w in words]
    distinct = sorted(set(flat))
    rows = dict(zip(distinct, range(len(distinct))))
    table = crf.feature_rows(distinct)
    weights, transitions = crf.fit(table[[rows[w] for w in flat]], np.array([len(t) for t in texts]), np.array(labels, np.int64))
    tagger = Tagger(weights, transitions, nothing.score_weights)
    scored = _with_evidence(sample, F.col("content"), tagger).select("label", "_evidence.*").toPandas()
    tagger.score_weights = crf.fit_logistic(scored[EVIDENCE].to_numpy(), scored["label"].to_numpy())
    return tagger


def _with_evidence(posts: DataFrame, content: Column, tagger: Tagger) -> DataFrame:
    shared = posts.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf(", ".join(f"{name} double" for name in EVIDENCE))
    def weigh(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = scorer_of(shared.value)
        for content in contents:
            yield pd.DataFrame(scorer.evidence(content.tolist()), columns=EVIDENCE)

    return posts.withColumn("_evidence", weigh(content.cast("string")))


def score_toxicity(posts: DataFrame, tagger: Tagger) -> DataFrame:
    """``posts`` with ``toxicity`` (0 to 1), the aggregate of all words' marginals; reads ``content`` alone, whole.

    Map only; the tagger, of fixed size, is broadcast.
    """
    *weights, linear = map(float, tagger.score_weights)
    linear = F.lit(linear)
    for name, weight in zip(EVIDENCE, weights):
        linear = linear + F.col("_evidence")[name] * weight
    carried = Carried(posts)
    scored = _with_evidence(carried.frame, carried["content"], tagger).withColumn("toxicity", 1 / (1 + F.exp(-linear)))
    return carried.restore(scored, ["toxicity"])


def toxic_spans(posts: DataFrame, tagger: Tagger, least: float = 0.5) -> DataFrame:
    """``posts`` with ``spans``: ``start``, ``length`` (code points) and ``marginal`` of every run of toxic words."""
    shared = posts.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf("array<struct<start:bigint,length:bigint,marginal:double>>")
    def mark(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_of(shared.value)
        for content in contents:
            yield pd.Series(scorer.spans(content.tolist(), least))

    carried = Carried(posts)
    return carried.restore(carried.frame.withColumn("spans", mark(carried["content"].cast("string"))), ["spans"])
