import itertools
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import edge_posts, no_posts

from modsieve.llm import crf, language, mixing, samples, toxicity
from modsieve.llm.queries import op8_language_id, op10_toxicity
from modsieve.session import materialize, read_table

MEDIUM = "/root/testdata/sf0.01"


def code_bits(text, counts, order):
    """Bits of one text in one language, byte by byte from plain dictionaries."""
    data, total = b" " * order + text, 0.0

    def share(context):
        """Distribution over all 256 bytes in a context."""
        lower = share(context[1:]) if context else np.full(256, 1 / 256)
        seen = counts.get(context)
        if seen is None:
            return lower
        n, kinds = sum(seen.values()), len(seen)
        rest = 1 - sum(lower[b] for b in seen)
        out = lower / rest * kinds / (n + kinds)
        for b, c in seen.items():
            out[b] = c / (n + kinds)
        return out

    for k in range(order, len(data)):
        total -= math.log2(share(data[k - order : k])[data[k]])
    return total


def test_code_lengths_by_brute_force(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "then that", "en"), (3, "der hund und die katze", "de")]
    trees = language.learn_languages(spark.createDataFrame(rows, "post_id long, content string, language string"), order=2)
    coder = language.Coder(trees)
    texts = [b"the mat", b"die", b"\xc3\xa9!", b"", b"zzz the der"]
    got = coder.lengths(texts)
    for k, name in enumerate(trees.languages):
        counts = {}
        for _, content, lang in rows:
            if lang == name:
                data = b"  " + content.encode()
                for at in range(2, len(data)):
                    for length in range(3):
                        slot = counts.setdefault(data[at - length : at], {})
                        slot[data[at]] = slot.get(data[at], 0) + 1
        for text, bits in zip(texts, got[:, k]):
            assert bits == pytest.approx(code_bits(text, counts, 2), rel=1e-5, abs=1e-5)


def test_long_text_is_coded_in_parts(spark, monkeypatch):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de")]
    coder = language.Coder(language.learn_languages(spark.createDataFrame(rows, "post_id long, content string, language string")))
    text = b"the hund " * 500
    for texts in ([text, b"x"], [b"x", text], [b"", b"der", text, text, b"", b"mat"]):
        monkeypatch.setattr(language, "CHUNK", 1 << 20)
        whole = coder.lengths(texts)
        monkeypatch.setattr(language, "CHUNK", 1_000)
        assert np.allclose(coder.lengths(texts), whole)
        assert np.allclose(whole, np.concatenate([coder.lengths([t]) for t in texts]))


def test_long_text_after_a_short_one_needs_little_memory(spark):
    rows = [(k, " ".join(f"{name}{k * j % 97}{name}" for j in range(50)), name) for k in range(20) for name in ("alpha", "beta", "gamma", "delta")]
    coder = language.Coder(language.learn_languages(spark.createDataFrame(rows, "post_id long, content string, language string")))
    words = "".join(f"word{k * k % 9973} " for k in range(1_000_000)).encode()
    assert len(words) > 8_000_000
    for texts in ([b"short", words], [words, b"short"]):
        tracemalloc.start()
        coder.lengths(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80_000_000


def test_every_language_is_learned_with_its_own_budget(spark):
    rows = [(k, f"common words of all and {chr(97 + k % 26) * 3}{chr(97 + k // 26) * 3} of one", f"l{k:03}") for k in range(130)]
    rows += [(1_000 + k, "common words of all, many times over", "l000") for k in range(300)]
    trees = language.learn_languages(spark.createDataFrame(rows, "post_id long, content string, language string"), contexts_per_language=60)
    assert len(trees.languages) == 130
    for k in range(130):
        own = set(zip(trees.length[trees.language == k].tolist(), trees.context[trees.language == k].tolist()))
        assert 40 < len(own) <= 60


def test_sample_holds_one_row_of_each_content(spark):
    rows = [(k, "the same" if k % 3 else f"text {k}", "en") for k in range(900)] + [(k, f"other {k}", "de") for k in range(5)] + [(1, None, "en"), (2, "x", None)]
    posts = spark.createDataFrame(rows, "post_id long, content string, language string")
    found = samples.labelled_sample(posts, "language", 100).collect()
    contents = [r["content"] for r in found if r["language"] == "en"]
    assert len(contents) == len(set(contents)) and 60 < len(contents) < 140 and sum(r["language"] == "de" for r in found) == 5
    assert samples.labelled_sample(posts.limit(0), "language", 100).count() == 0


def test_languages_of_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in read_table(spark, MEDIUM, "documents").collect()}
    held = [r for r in op8_language_id(spark, MEDIUM).collect() if r["held_out"]]
    assert len(held) > 150 and sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_edge_posts(spark):
    trees = language.learn_languages(edge_posts(spark))
    assert trees.languages == ["de", "en", "fr"]
    found = language.predict_language(edge_posts(spark), trees)
    rows = {r["post_id"]: r for r in found.collect()}
    assert len(rows) == 10 and set(edge_posts(spark).columns) < set(found.columns)
    assert {k for k, r in rows.items() if r["language_pred"] == "und"} == {2, 3, 4, 9} and rows[2]["language_score"] == 0
    assert language.predict_language(no_posts(spark), trees).count() == 0
    none = language.learn_languages(no_posts(spark))
    assert {r["language_pred"] for r in language.predict_language(edge_posts(spark), none).collect()} == {"und"}


def shared_out(sizes, share, most, weights):
    """Excess handed on, round after round."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    target, open_names, left = {}, set(names), share * sum(sizes.values())
    while open_names:
        level = left / sum(weight[n] for n in open_names)
        full = {n for n in open_names if level * weight[n] > most * sizes[n]}
        if not full:
            return target | {n: level * weight[n] for n in open_names}
        for n in full:
            target[n] = most * sizes[n]
            left -= target[n]
        open_names -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, None: 50, "d": 3}, {"a": 5}, {"a": 0, "b": 7}, {"x": 1000, "y": 1, "z": 1, None: 1}])
def test_targets(spark, sizes):
    rows = [(k, " ".join(["w"] * n), name) for k, (name, n) in enumerate(sizes.items())]
    frame = spark.createDataFrame(rows, "post_id long, content string, category string")
    got = {r["category"]: r["target"] for r in mixing.copies_of(frame).collect()}
    assert got == pytest.approx(shared_out(sizes, 1.5, 2.0, [3, 1, 2]))


@pytest.mark.parametrize("name", ["null", "one", "pairs"])
def test_targets_are_met_whatever_the_ids(spark, name):
    rows = [({"null": None, "one": 7, "pairs": k // 2}[name], "same words here" if k % 2 else f"words {k % 5} here", c) for c in "abc" for k in range(400)]
    frame = spark.createDataFrame(rows, "post_id long, content string, category string").repartition(4)
    written = materialize(frame, "posts")
    found = mixing.copies_of(written).collect()
    for c, target in (("a", 2_400), ("b", 1_000), ("c", 2_000)):
        own = [r for r in found if r["category"] == c]
        assert own[0]["target"] == target and abs(sum(r["size"] * r["copies"] for r in own) - target) <= 150
        assert max(r["copies"] for r in own) <= 2
    assert sorted(map(str, mixing.copies_of(written).collect())) == sorted(map(str, found))


def test_spans_of_contents_that_lower_case_lengthens(spark):
    text = "İİİ vile"
    assert toxicity.lowered(text) == "İİİ vile" and len(toxicity.lowered("İx ΑΣ")) == 5
    weights = np.zeros(crf.WIDTH, np.float32)
    weights[list(set(crf.word_features("vile")) - set(crf.word_features("İİİ")))] = 50
    tagger = toxicity.Tagger(weights, np.array([[0.0, -1.0], [0.0, 0.0]]), np.array([0.0] * (len(toxicity.EVIDENCE) + 1)))
    (span,) = toxicity.Scorer(tagger).spans([text], 0.9)[0]
    assert text[span["start"] : span["start"] + span["length"]] == "vile"


def test_mix_meets_targets_and_reruns_agree(spark):
    frame = spark.range(6_000).select(F.col("id").alias("post_id"), F.lit("one two three").alias("content"), F.expr("array('PASS', 'FLAG', 'BLOCK', null)[id % 4]").alias("category"))
    counted = mixing.copies_of(frame)
    sums = counted.groupBy("category", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("copies").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.06 * r["target"] and r["most"] <= 2 for r in sums)
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and mixed.count() == counted.agg(F.sum("copies")).first()[0]
    assert sorted(r["post_id"] for r in mixed.collect()) == sorted(r["post_id"] for r in mixing.mix(frame.repartition(7)).collect())


def test_mix_edge_posts(spark):
    counted = mixing.copies_of(edge_posts(spark))
    assert counted.count() == 11 and {r["size"] for r in counted.filter("post_id in (2, 3, 4)").collect()} == {0}
    assert mixing.mix(edge_posts(spark)).columns == edge_posts(spark).columns
    assert mixing.mix(no_posts(spark)).count() == 0 and mixing.copies_of(no_posts(spark)).count() == 0


@pytest.mark.parametrize("block", [3, 64])
def test_chain_by_brute_force(monkeypatch, block):
    monkeypatch.setattr(crf, "BLOCK", block)
    rng = np.random.default_rng(1)
    sizes = np.array([5, 0, 1, 9, 3])
    scores, transitions = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    chains = crf.Chains(scores, sizes, transitions)
    marginals, clean, pairs = chains.marginals(), chains.clean_log_probability(), np.zeros((2, 2))
    at = 0
    for n, log_clean in zip(sizes, clean):
        total, ones, none, steps = 0.0, np.zeros(n), 0.0, np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=int(n)):
            weight, before, own = 0.0, 0, np.zeros((2, 2))
            for k, s in enumerate(states):
                weight += transitions[before, s] + s * scores[at + k]
                own[before, s] += 1
                before = s
            weight = math.exp(weight)
            total += weight
            ones += weight * np.array(states)
            steps += weight * own
            none += weight * (sum(states) == 0)
        assert np.allclose(ones / total, marginals[at : at + n]) and math.isclose(none / total, math.exp(log_clean), rel_tol=1e-9)
        pairs += steps / total
        at += n
    assert np.allclose(pairs, chains.pair_sums())


def test_toxicity_of_held_out_documents(spark):
    toxic = {r["doc_id"]: r["toxic"] for r in read_table(spark, "/root/testdata/sf0.1", "labels").collect()}
    held = [r for r in op10_toxicity(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in toxic]
    right = sum(r["predicted"] == toxic[r["doc_id"]] for r in held)
    found = sum(r["predicted"] for r in held if toxic[r["doc_id"]])
    assert right >= 0.97 * len(held) and found >= 0.85 * sum(toxic[r["doc_id"]] for r in held)


@pytest.fixture(scope="module")
def tagger(spark):
    rude = [f"the {a} post by {b} {w} {c} words" for a, b, c, w in itertools.product("abcd", "xyz", "kl", ["vileness", "vilely", "grotty"])]
    kind = [f"the {a} post by {b} {w} {c} words" for a, b, c, w in itertools.product("abcd", "xyz", "kl", ["nice", "fine", "long", "short"])]
    rows = [(k, t, 1) for k, t in enumerate(rude)] + [(1_000 + k, t, 0) for k, t in enumerate(kind)]
    posts = spark.createDataFrame(rows, "post_id long, content string, toxic int")
    return toxicity.learn_toxicity(posts, posts.select("post_id", "toxic"))


def test_spans_and_scores(spark, tagger):
    posts = spark.createDataFrame([(1, "A fine post. Then Vileness grotty, and calm."), (2, "A fine calm post."), (3, None)], "post_id long, content string")
    rows = {r["post_id"]: r for r in toxicity.toxic_spans(toxicity.score_toxicity(posts, tagger), tagger).collect()}
    assert [(s["start"], s["length"]) for s in rows[1]["spans"]] == [(18, 15)] and rows[2]["spans"] == [] and rows[3]["spans"] == []
    assert rows[1]["toxicity"] > 0.5 > rows[2]["toxicity"]


def test_toxicity_edge_posts(spark, tagger):
    scored = toxicity.score_toxicity(edge_posts(spark), tagger)
    assert set(edge_posts(spark).columns) < set(scored.columns)
    assert all(0 <= r["toxicity"] <= 1 for r in scored.collect()) and scored.count() == 11
    assert toxicity.score_toxicity(no_posts(spark), tagger).count() == 0
    untaught = toxicity.learn_toxicity(no_posts(spark), no_posts(spark))
    assert all(r["toxicity"] < 1e-6 for r in toxicity.score_toxicity(edge_posts(spark), untaught).collect())
