import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from labelled_posts import BENCHMARK_POSTS
from pyspark.sql import functions as F

from modsieve.functions import patterns as P
from modsieve.functions import text as T
from modsieve.operators import keyword_index as index
from modsieve.operators import lexicon as X
from modsieve.operators.stages import rules_stage
from modsieve.plans import fixtures


def reasons(spark, texts, **kw):
    stage = rules_stage(**kw)
    posts = spark.createDataFrame(list(enumerate(texts)), "post_id long, content string")
    rows = stage.prepare(posts).select("post_id", stage.decide(posts, []).alias("r")).orderBy("post_id").collect()
    return [row.r.reason.removeprefix("lexical_rule: ") for row in rows]


EDGES = [
    ("", "passed"), ("   ", "passed"), (" ", "passed"), ("\U0001f605", "passed"), ("élan café", "passed"),
    ("HTTP://X", "passed"), ("http://x", "suspicious_url"), ("$ab", "passed"), ("$abc", "crypto_address"),
    ("$" + "a" * 21, "passed"), ("a1" * 12 + "a", "passed"), ("a1" * 13, "crypto_address"), ("a1" * 17 + "a", "crypto_address"),
    ("a1" * 18, "passed"), ("é" + "a1" * 13, "passed"), ("_" + "a1" * 13, "passed"), ("sca\nmm\ner", "scammer"),
    ("s12c12a12m12m12e12r", "scammer"), ("s123cammer", "passed"), ("FRAUD", "fraud"), ("of rau d", "fraud"),
    ("frau", "passed"), ("Double the money", "passed"), ("double my money", "double money"), ("counterfeit fraud", "fraud"),
    ("pay $500 http://x", "crypto_address"), ("GB29NWBK60161331926819", "crypto_address"), ("0x" + "aB" * 20, "crypto_address"),
]


def test_edge_rows(spark):
    got = reasons(spark, [text for text, _ in EDGES])
    assert got == [want for _, want in EDGES]


def test_null_content_passes(spark):
    assert reasons(spark, [None]) == ["passed"]


def test_labelled_posts_fire_only_on_cash_tags(spark):
    named = [(f"{cat}_{i}", text) for cat, texts in BENCHMARK_POSTS.items() for i, text in enumerate(texts, 1)]
    got = dict(zip([n for n, _ in named], reasons(spark, [t for _, t in named])))
    assert {n: r for n, r in got.items() if r != "passed"} == {"spam_1": "crypto_address", "fraud_4": "crypto_address"}


def test_planted_branches_all_occur(spark, small):
    stage = rules_stage()
    posts = stage.prepare(fixtures.planted(spark, small))
    seen = {r.reason for r in posts.select(stage.decide(posts, [])["reason"].alias("reason")).distinct().collect()}
    assert {"lexical_rule: scammer", "lexical_rule: double money", "lexical_rule: crypto_address",
            "lexical_rule: suspicious_url", "lexical_rule: passed"} <= seen


def test_address_kinds_and_urls(spark):
    row = spark.createDataFrame([("0x" + "ab" * 20 + " $abc https://a.b/c?d http://e",)], "t string").select(
        P.address_kinds(F.col("t")).alias("k"), P.urls(F.col("t")).alias("u")).first()
    assert row.k == ["ethereum", "cash_tag"] and row.u == ["https://a.b/c?d", "http://e"]


def reference_first(keywords, squashed):
    return next((i for i, k in enumerate(keywords) if re.search(X.fuzzy_pattern(k), squashed)), None)


@pytest.mark.parametrize("size", [5, 31, 60, 700])
def test_first_and_all_hits_match_brute_force(spark, small, size):
    table = fixtures.phrase_keywords(spark, small).orderBy("kw_idx").limit(size)
    lexicon = X.Lexicon.of([r.keyword for r in table.collect()] + ["act now", "dm me"])
    posts = fixtures.planted(spark, small)
    first = {r.post_id: r.kw_idx for r in X.first_hits(posts, lexicon).collect()}
    every = {}
    for r in X.lexicon_hits(posts, lexicon).collect():
        assert lexicon.keywords[r.kw_idx] == r.keyword
        every.setdefault(r.post_id, set()).add(r.kw_idx)
    assert first and {p: min(v) for p, v in every.items()} == first
    for row in posts.select("post_id", T.squash(F.col("content")).alias("s")).collect():
        want = {i for i, k in enumerate(lexicon.keywords) if re.search(X.fuzzy_pattern(k), row.s)}
        assert every.get(row.post_id, set()) == want


def test_given_numbers_are_kept_over_blocks(spark, monkeypatch):
    posts = spark.createDataFrame([(1, "all about cats"), (2, "d-o g s and birds"), (3, "none")], "post_id long, content string")
    table = spark.createDataFrame([(5, "!!!"), (10, "birds"), (20, "dogs"), (400, "cats"), (7_000_000_000, "cat")], "kw_idx long, keyword string")
    for size in (1, 2, 10):
        blocks = list(X.keyword_blocks(table, size))
        assert [n for b in blocks for n in b.numbers] == [10, 20, 400, 7_000_000_000]
        monkeypatch.setattr(X, "keyword_blocks", lambda t, s=size, f=X.keyword_blocks: iter(blocks))
        assert {(r.post_id, r.kw_idx, r.keyword) for r in X.first_hits(posts, table).collect()} == {(1, 400, "cats"), (2, 10, "birds")}
        assert {(r.post_id, r.kw_idx) for r in X.lexicon_hits(posts, table).collect()} == {(1, 400), (1, 7_000_000_000), (2, 10), (2, 20)}
        monkeypatch.undo()


def test_index_join_keeps_given_numbers(spark):
    posts = spark.createDataFrame([(1, "all about cats"), (2, "d-o g s and birds"), (3, "none"), (4, None), (5, "")], "post_id long, content string")
    table = spark.createDataFrame([(5, "!!!"), (10, "birds"), (20, "dogs"), (400, "cats"), (7_000_000_000, "cat"), (8, None)], "kw_idx long, keyword string")
    found = index.indexed_hits(posts, table)
    assert {(r.post_id, r.kw_idx) for r in found.collect()} == {(1, 400), (1, 7_000_000_000), (2, 10), (2, 20)}
    assert {(r.post_id, r.kw_idx, r.keyword) for r in X.first_hit_per_post(found).collect()} == {(1, 400, "cats"), (2, 10, "birds")}
    assert index.indexed_hits(posts, table.limit(0)).count() == index.indexed_hits(posts.limit(0), table).count() == 0


def test_index_join_keeps_repeated_rows_and_posts_without_an_id(spark):
    posts = spark.createDataFrame([("a", "bad cat"), ("a", "bad cat"), (None, "c a t"), (None, "dog"), ("b", "a cat")], "post_id string, content string")
    table = spark.createDataFrame([(1, "cat"), (1, "cat"), (2, "bad"), (3, "t")], "kw_idx int, keyword string")
    found = Counter((r.post_id, r.kw_idx) for r in index.indexed_hits(posts, table).collect())
    assert found == {("a", 1): 4, ("a", 2): 2, ("a", 3): 2, (None, 1): 2, (None, 3): 1, ("b", 1): 2, ("b", 3): 1}


def test_index_join_equals_the_lexicon(spark, small):
    """Also with every gram split into many shares."""
    posts, table = fixtures.planted(spark, small), fixtures.phrase_keywords(spark, small)
    short = spark.createDataFrame([(-1, "a"), (-2, "zx"), (-3, "the"), (-4, "q 7")], "kw_idx long, keyword string")
    table = table.unionByName(short)
    want = sorted(X.lexicon_hits(posts, X.Lexicon.from_table(table)).collect())
    assert len({r.kw_idx for r in want}) > 3
    before = index.POSTS_A_SHARE
    for posts_a_share in (before, 3):
        index.POSTS_A_SHARE = posts_a_share
        try:
            assert sorted(index.indexed_hits(posts, table).collect()) == want
        finally:
            index.POSTS_A_SHARE = before


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab0", max_size=5).filter(len), min_size=1, max_size=6), st.lists(st.one_of(st.none(), st.text("ab0z", max_size=16)), max_size=5),
       st.integers(1, 40))
def test_posts_hold_the_grams_of_all_that_hit(keywords, texts, chunk):
    digit = {c: k + 1 for k, c in enumerate(index.LETTERS)}
    number = {g: sum(digit[c] * index.BASE ** k for k, c in enumerate(g))
              for w in keywords for g in [w[k : k + index.GRAM] for k in range(max(1, len(w) - index.GRAM + 1))]}
    before, (index.CHUNK, index.TOGETHER, index.MOST_FOUND) = (index.CHUNK, index.TOGETHER, index.MOST_FOUND), (chunk, 2 * chunk, 3)
    try:
        grams = index.Grams(index.Grams.bits_of(np.array(list(number.values()))))
        parts = list(grams.held_in_parts(texts))
        rows, found = (np.concatenate([p[k] for p in parts] + [np.zeros(0, np.int64)]) for k in (0, 1))
    finally:
        index.CHUNK, index.TOGETHER, index.MOST_FOUND = before
    want = {(k, n) for k, text in enumerate(texts) for g, n in number.items() if re.search(X.fuzzy_pattern(g), text or "")}
    assert set(zip(rows.tolist(), found.tolist())) == want and len(rows) == len(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab0", min_size=1, max_size=index.PART), min_size=1, max_size=6), st.lists(st.one_of(st.none(), st.text("ab0z", max_size=40)), max_size=5),
       st.integers(1, 40))
def test_posts_hold_the_runs_of_all_that_hit(runs, texts, chunk):
    name = {r: int(index.Runs.name(index.Runs.numbers_of(r))[-1]) for r in runs}
    before, (index.CHUNK, index.TOGETHER, index.MOST_FOUND) = (index.CHUNK, index.TOGETHER, index.MOST_FOUND), (chunk, 2 * chunk, 3)
    try:
        parts = list(index.Runs(index.Runs.bits_of(runs)).held_in_parts(texts))
    finally:
        index.CHUNK, index.TOGETHER, index.MOST_FOUND = before
    want = {(k, n) for k, text in enumerate(texts) for r, n in name.items() if re.search(X.fuzzy_pattern(r), text or "")}
    assert sorted((int(k), int(n)) for rows, found in parts for k, n in zip(rows, found)) == sorted(want)


def test_runs_in_a_text_of_one_letter():
    runs = index.Runs(index.Runs.bits_of(["a" * index.PART, "b" * index.PART]))
    rows, found = runs.held_by(["a" * 70_000, "b" * 5])
    assert rows.tolist() == [0] and found.tolist() == index.Runs.name(index.Runs.numbers_of("a" * index.PART)[-1:]).tolist()


def test_index_join_takes_up_few_posts_that_do_not_hit(spark, small, monkeypatch):
    """Posts hold most short runs of any keyword; what is compared with whole texts is near what hits."""
    sizes = {}
    monkeypatch.setattr(index, "materialize", lambda df, name, f=index.materialize: sizes.setdefault(name, f(df, name)))
    posts, table = fixtures.planted(spark, small), fixtures.benchmark_keywords(spark, small)
    hits = index.indexed_hits(posts, table).count()
    assert 0 < hits and sizes["post_runs"].count() < posts.count()


def test_more_than_100_000_keywords(spark):
    table = spark.range(100_500).selectExpr("id * 3 as kw_idx", "concat('zq', lpad(conv(id, 10, 36), 5, '0')) as keyword")
    posts = spark.createDataFrame([(1, "x zq0024k y"), (2, "nothing"), (3, "zq 0 2 5 j n")], "post_id long, content string")
    found = {r.post_id: (r.kw_idx, r.keyword) for r in X.first_hits(posts, table).collect()}
    assert set(found) == {1, 3}
    for post, text in ((1, "xzq0024ky"), (3, "zq025jn")):
        number, keyword = found[post]
        assert re.search(X.fuzzy_pattern(keyword), text) and table.filter(f"kw_idx = {number}").first().keyword == keyword


def test_plan_does_not_grow_with_the_keywords(spark):
    posts = spark.createDataFrame([(1, "one zq00001 two zq0200q")], "post_id long, content string")
    plans = []
    for n in (10, 100_000):
        table = spark.range(n).selectExpr("id as kw_idx", "concat('zq', lpad(id, 6, '0')) as keyword")
        for found in (X.first_hits(posts, table), index.indexed_hits(posts, table)):
            plans.append(len(found._jdf.queryExecution().toString()))
    assert plans[2] == pytest.approx(plans[0], rel=0.05) and plans[3] == pytest.approx(plans[1], rel=0.05)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=8), st.text("abc", max_size=14))
def test_combined_pattern_is_the_or_of_its_keywords(keywords, text):
    either = any(re.search(X.fuzzy_pattern(k), text) for k in keywords)
    assert bool(re.search(X.combined_pattern(keywords), text)) == either


def test_keywords_without_letters_are_left_out(spark):
    assert X.Lexicon.of(["***", "ok"]).keywords == ("ok",)
    assert reasons(spark, ["anything"], lexicon=X.Lexicon.of(["---"])) == ["passed"]


def test_one_letter_text_of_30000_chars(spark):
    assert reasons(spark, ["s" * 30_000]) == ["passed"]


def test_squash_and_addresses_equal_their_plain_forms(spark):
    from modsieve import constants as K

    odd = ["", "É", "İ", "K", "ſ", "ß", "_", "\n", "😅", "٣", "x", " ", ".", "-"]
    cores = ["1" + "Ab2" * 10, "0x" + "ab" * 20, "GB29NWBK60161331926819", "xy7" * 9, "$abc", "$ab", "q" * 25, "q" * 26, "q" * 36, "3" + "B" * 25, "0x" + "ab" * 19]
    rows = [(a + core + b,) for core in cores for a in odd for b in odd] + [(f"{a}Ab{b}9",) for a in odd for b in odd] + [(None,)]
    posts, c = spark.createDataFrame(rows, "content string"), F.col("content")
    plain = F.lit(False)
    for pattern in K.ADDRESS_PATTERNS.values():
        plain = plain | c.rlike(pattern)
    kinds = F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in K.ADDRESS_PATTERNS.items()]))
    same = plain.eqNullSafe(P.has_address(c)) & kinds.eqNullSafe(P.address_kinds(c)) & T.squash(c).eqNullSafe(F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""))
    assert posts.filter(~same).collect() == [] and posts.filter(plain).count() > 100


def test_answers_do_not_travel_with_the_scores(spark, small):
    plan = fixtures.decided(spark, small)._jdf.queryExecution().optimizedPlan()
    joins = [node for node in [plan.apply(k) for k in range(40)] if node is not None and node.nodeName() == "Join"]
    assert joins and "verdict_response" not in joins[0].output().mkString(",")


def test_rare_parts_rule_out_no_hit(spark):
    words = ["the quick brown fox jumps over", "an easy sentence to read", "zz", "attention is all"] + [f"filler phrase number {k}" for k in range(60)]
    lexicon = X.Lexicon.of(words)
    assert len(X.rare_part(words[0])) == X.PART
    assert all(X.rare_part(w) in X.squash_keyword(w) for w in words)
    texts = [f"some {'x.y'.join(w)} tail" for w in words] + [f"a {w} b" for w in words] + [X.rare_part(w) for w in words] + ["", None, "nothing here"]
    posts = spark.createDataFrame([(t,) for t in texts], "content string").select(T.squash(F.col("content")).alias("s"))
    s = F.col("s")
    tried = F.array_compact(F.array(*[F.when(s.rlike(X.fuzzy_pattern(w)), k) for k, w in enumerate(words)]))
    assert posts.filter(s.isNotNull() & ~(lexicon.all_hits(s).eqNullSafe(tried))).collect() == []
    assert posts.filter(s.isNotNull() & ~(lexicon.first_hit(s).eqNullSafe(F.get(tried, F.lit(0))))).collect() == []
