"""From raw documents to packed sequences: language, exact copies, near copies, mixture, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modsieve.llm import exact_dedup, language, mixing, packing, shingles
from modsieve.llm.queries import LIMIT, VOCABULARY, posts_of, share_package
from modsieve.operators.rows import filter_once
from modsieve.session import materialize, read_table


def _posts(docs: DataFrame) -> DataFrame:
    """Documents as posts, their own columns beside under numbered names."""
    own = [F.col(f"`{name}`").alias(f"d{k}") for k, name in enumerate(docs.columns)]
    return docs.select(*own, F.col("doc_id").alias("post_id"), F.col("text").alias("content"), F.col("source").alias("category"), F.col("lang").alias("language"))


def _documents(posts: DataFrame, docs: DataFrame, **replaced: str) -> DataFrame:
    """Back to the columns of ``docs``; ``replaced`` names the posts' column that takes the place of one."""
    return posts.select(*[F.col(replaced.get(name, f"d{k}")).alias(name) for k, name in enumerate(docs.columns)])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model can name; no text and no letter go.  ``lang`` becomes the predicted one."""
    share_package(spark)
    posts = _posts(docs)
    predicted = language.predict_language(posts, language.learn_languages(posts.select("content", "language")))
    return _documents(filter_once(predicted, F.col("language_pred") != language.UNDETERMINED), docs, lang="language_pred")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every text."""
    share_package(spark)
    index = exact_dedup.new_index(spark)
    kept = exact_dedup.keep_first(_posts(docs), index)
    index.close()
    return _documents(kept, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: SimHash pairs and min-hash bands over five-word shingles, similarity of at least 0.8."""
    share_package(spark)
    return _documents(shingles.keep_one(_posts(docs)), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and left out so that every source comes near its target."""
    share_package(spark)
    return _documents(mixing.mix(_posts(docs)), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of one length."""
    share_package(spark)
    pieces = packing.pack(posts_of(docs), public_tokenizers.path(VOCABULARY), LIMIT, end_id=1)
    return pieces.select(F.col("post_id").alias("doc_id"), "start", "length", "ids_crc32", F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("simhash", drop_near_copies), ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Languages, fingerprints and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``, every result written before the next stage reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
