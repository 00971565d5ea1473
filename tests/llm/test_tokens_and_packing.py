import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tables import edge_posts, no_posts
from tokenizers import Tokenizer

from modsieve.llm import packing, token_counts
from modsieve.llm.queries import op1_token_counts, op7_packing
from modsieve.llm.vocabulary import Vocabulary
from modsieve.session import read_table

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_every_prefix_as_the_library_counts_it():
    vocabulary = Vocabulary(PATH)
    rng = random.Random(3)
    letters = "aAbetsiTHE  '''sdlrevm.,!?0129éÉßñ\t\n"
    for k in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 24)))
        if k % 7 == 0:
            text = f"{text[:5]}<|endoftext|>{text[5:]}"
        assert vocabulary.counts(text).tolist() == [len(library_ids(text[: i + 1])) for i in range(len(text))], repr(text)


def test_whole_texts_of_any_script():
    vocabulary = Vocabulary(PATH)
    rng = random.Random(4)
    letters = "aé  'sİΣςŉ漢字́\x1c\x85 ſﬁ①🙂🏽<|>ÅÅ"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
        ids = library_ids(text)
        assert np.frombuffer(vocabulary.ids(text), "<u4").tolist() == ids, repr(text)
        assert (vocabulary.counts(text)[-1] if text else 0) == len(ids), repr(text)


def test_counts_of_edge_posts(spark):
    rows = token_counts.prefix_token_counts(edge_posts(spark), PATH, ["content", "size"]).collect()
    assert len(rows) == 11
    for row in rows:
        assert row["n_tokens"] == len(library_ids(row["content"])) and row["size"] == "own"
        assert (row["prefix_tokens"][-1] if row["prefix_tokens"] else 0) == row["n_tokens"]
    assert token_counts.prefix_token_counts(no_posts(spark), PATH).count() == 0


def test_truncation(spark):
    text = "The moderation of unbelievably long posts isn't done by hand, 2024!"
    counted = token_counts.prefix_token_counts(spark.createDataFrame([(1, text), (2, None)], "post_id long, content string"), PATH)
    prefix = [len(library_ids(text[:i])) for i in range(len(text) + 1)]
    for budget in (0, 1, 5, 9, 100):
        row = counted.orderBy("post_id").select(token_counts.longest_prefix(F.col("prefix_tokens"), budget), token_counts.tokens_of_prefix(F.col("prefix_tokens"), budget)).collect()
        assert row[0][0] == max(i for i, n in enumerate(prefix) if n <= budget)
        assert row[0][1] == prefix[min(budget, len(text))] and row[1][0] == 0 and row[1][1] == 0


def test_query_counts_whole_table(spark, small):
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, small, "documents").collect()}
    rows = op1_token_counts(spark, small).collect()
    assert len(rows) == len(texts)
    for row in rows:
        n = len(library_ids(texts[row["doc_id"]]))
        assert (row["n_tokens"], row["over_limit"], row["n_bytes"]) == (n, n > 2048, len((texts[row["doc_id"]] or "").encode()))


def check_pieces(texts, pieces, length=2048):
    """Pieces of each document are its ids in order; sequences are gapless and full but for the last."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
        by_sequence.setdefault(p[5], []).append((p[6], p[2]))
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids, at = np.array([*library_ids(text), 1], "<u4"), 0
        for _, start, size, crc, total, _, _ in sorted(by_doc[doc], key=lambda p: p[1]):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids[at : at + size].tobytes()))
            at += size
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, parts in by_sequence.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == length or (k == len(by_sequence) - 1 and 0 < at <= length)


def test_query_packs_whole_table(spark, small):
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, small, "documents").collect()}
    check_pieces(texts, [tuple(r) for r in op7_packing(spark, small).collect()])


@pytest.mark.parametrize("parts", [1, 5])
def test_packing_edge_posts(spark, parts):
    posts = edge_posts(spark).dropDuplicates(["post_id"]).repartition(parts)
    pieces = packing.pack(posts, PATH, length=64).collect()
    check_pieces({r["post_id"]: r["content"] for r in posts.collect()}, [tuple(r) for r in pieces], 64)
    assert packing.pack(no_posts(spark), PATH).count() == 0
    # repeated rows are packed as often as they occur
    twice = packing.pack(edge_posts(spark).filter("post_id = 1"), PATH).collect()
    assert len(twice) == 2 and {r["offset"] for r in twice} == {0, twice[0]["n_tokens"]}
