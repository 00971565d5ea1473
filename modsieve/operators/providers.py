"""Where scores come from.

Three kinds of provider, all ``DataFrame -> DataFrame`` adding one column:

* a score table joined on the post key (:func:`score_table`),
* column arithmetic (:func:`scorecard`),
* a vectorised Python model (:func:`batch_scorer`), loaded once per worker, that is handed null
  for posts an earlier stage has already blocked, so that a blocked post costs nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_table(posts: DataFrame, scores: DataFrame, name: str, key: str = "post_id") -> DataFrame:
    """Left join on the post key; all columns of ``scores`` but the key land in one struct ``name``.

    Join before wide text columns are needed again: the join moves whatever the posts carry.  A
    post without a score row gets a null struct, which the stages read as "scorer unavailable".
    """
    fields = [c for c in scores.columns if c != key]
    packed = scores.select(F.col(key).alias("_score_key"), F.struct(*fields).alias(name))
    return posts.join(packed, posts[key] == packed["_score_key"], "left").drop("_score_key")


def score_join(posts: DataFrame, scores: DataFrame, key: str = "post_id") -> DataFrame:
    """Left join that keeps score columns flat and says whether a score was there."""
    marked = scores.withColumn("scored", F.lit(True))
    return posts.join(marked, key, "left").withColumn("scored", F.coalesce("scored", F.lit(False)))


def scorecard(weights: dict[str, list[float]], intercept: list[float]) -> Column:
    """Linear score per class over feature columns, turned into probabilities by softmax."""
    classes = range(len(intercept))
    linear = [F.lit(float(intercept[c])) for c in classes]
    for feature, per_class in weights.items():
        for c in classes:
            if per_class[c]:
                linear[c] = linear[c] + F.lit(float(per_class[c])) * F.col(feature)
    raised = [F.exp(z) for z in linear]
    total = raised[0]
    for r in raised[1:]:
        total = total + r
    return F.array(*[r / total for r in raised])


#: Models of this worker process, by scorer.
MODELS: dict[str, Callable] = {}


def loaded(name: str, load: Callable[[], Callable]) -> Callable:
    if name not in MODELS:
        MODELS[name] = load()
    return MODELS[name]


def batch_scorer(load: Callable[[], Callable[[pd.Series], pd.DataFrame]], schema: str, timed: str | None = None) -> Callable[[Column], Column]:
    """Wrap a Python model as a column function.

    ``timed`` names a double field of ``schema`` that gets the measured seconds of a text: those of its batch, shared out evenly.
    ``load`` runs once per Python worker process and returns a function from a series of texts to a frame
    with the fields of ``schema``.  Null texts never reach the model and come back as nulls.
    """
    name = uuid.uuid4().hex

    @F.pandas_udf(schema)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loaded(name, load)
        for texts in batches:
            asked = texts[texts.notna()]
            began = time.perf_counter()
            answers = model(asked) if len(asked) else None
            if timed and answers is not None:
                answers[timed] = (time.perf_counter() - began) / len(asked)
            if answers is None:
                yield pd.DataFrame(index=texts.index, columns=_field_names(schema), dtype=object)
            else:
                answers.index = asked.index
                yield answers.reindex(texts.index)[_field_names(schema)]

    return score.asNondeterministic()


def _field_names(schema: str) -> list[str]:
    return [part.strip().split()[0] for part in schema.split(",")]


def masked(content: Column, earlier: list[Column]) -> Column:
    """The text, or null once an earlier result is BLOCK."""
    blocked = F.lit(False)
    for step in earlier:
        blocked = blocked | (step["decision"] == "BLOCK")
    return F.when(~blocked, content)
