import math
import random
import re
from collections import Counter

from tables import edge_posts, no_posts

from modsieve.llm import hard_negatives, search, url_filters
from modsieve.session import materialize

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_links(links, rules):
    found = []
    for url in links:
        at = (url or "").find("://")
        rest = url[at + 3 :] if url and at >= 0 else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        best = max(((len(own) + len(start), len(own), decision == "BLOCK", own + start) for rule, decision in rules
                    for own, start in [(rule.split("/")[0], rule[len(rule.split("/")[0]) :])] if (host == own or host.endswith("." + own)) and path.startswith(start)), default=None)
        found.append((host, path, best and best[3], "BLOCK" if best and best[2] else "ACCEPT"))
    return found


def judged(spark, links, rules, **kept):
    table = spark.createDataFrame([(k, url) for k, url in enumerate(links)], "post_id long, url string")
    listed = spark.createDataFrame(rules, "rule string, decision string")
    rows = url_filters.judge_links(table, listed, **kept).orderBy("post_id").collect()
    return [(r["host"], r["path"], r["rule"], r["decision"]) for r in rows]


def test_links_by_brute_force(spark):
    rng = random.Random(11)
    hosts = [".".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/en/", "/en/x", "/e", "/de/y/z", "/en"]
    links = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#top'])}" for _ in range(500)]
    links += [None, "", "no scheme", "://", "HTTP://A.B/En/", "x://y://z/", "http://ä.b/en/ü\n/z", "http://" + "a." * 2_000 + "b/en/", "http://a/" + "p" * 50_000, *links[:5]]
    rules = [(rng.choice(hosts).upper() if rng.random() < 0.2 else rng.choice(hosts), rng.choice(paths), rng.choice(["ACCEPT", "BLOCK"])) for _ in range(80)]
    rules = [(host + path, decision) for host, path, decision in rules]
    plain = [("".join(c.lower() if "A" <= c <= "Z" else c for c in rule.split("/")[0]) + rule[len(rule.split("/")[0]) :], decision) for rule, decision in rules]
    noise = [(None, "BLOCK"), ("", "BLOCK"), ("/en/", "BLOCK"), ("a/", None), ("a/", "other")]
    expected = brute_links(links, plain)
    assert judged(spark, links, rules + noise + rules[:3]) == expected
    # a list too large for one cascade is dealt into several
    assert judged(spark, links, rules, most_bits=300) == expected
    assert {r[2:] for r in judged(spark, links, noise)} == {(None, "ACCEPT")}


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).selectExpr("concat('key ', id) as key")
    listed = materialize(keys.filter("hash(key) % 40 = 0"), "listed")
    cascade = url_filters.build_cascade(keys, listed)
    assert len(cascade.filters) > 2
    told = {r["key"] for r in keys.filter(cascade.contains(keys["key"])).collect()}
    assert told == {r["key"] for r in listed.collect()}
    # the first filter alone lets others through, so the later ones have work to do
    assert keys.filter(cascade.filters[0].passes(keys["key"])).count() > len(told)
    # about 1.44 bits for each doubling of the keys over the list, and 4 more
    assert sum(f.bits for f in cascade.filters) < len(told) * (1.44 * math.log2(20_000 / len(told)) + 8) + 64 * len(cascade.filters)
    assert not url_filters.build_cascade(keys, listed.limit(0)).filters


def test_links_of_posts_and_columns(spark):
    posts = spark.createDataFrame([(1, "see https://spam.net/x and http://ok.org"), (2, "none"), (3, None)], "post_id long, content string")
    links = url_filters.links_of(posts).selectExpr("*", "'mine' as HOST", "'mine' as _best", "1 as c0", "'kept' as key")
    rules = spark.createDataFrame([("net/", "BLOCK")], "rule string, decision string")
    out = url_filters.judge_links(links, rules)
    assert out.columns == ["post_id", "url", "_best", "c0", "key", "host", "path", "rule", "decision"]
    assert sorted((r["host"], r["decision"], r["_best"], r["key"]) for r in out.collect()) == [("ok.org", "ACCEPT", "mine", "kept"), ("spam.net", "BLOCK", "mine", "kept")]
    assert url_filters.judge_links(links.limit(0), rules).count() == 0


def brute_terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term) for term in TERM.findall(text or "")]


def brute_search(posts, queries, k):
    counted = [(i, c) for i, c in ((i, Counter(brute_terms(text))) for i, text in posts) if c]
    n, volume = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(term for _, c in counted for term in c)
    out = []
    for query_id, text in queries:
        weights = [(t, math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) for t in brute_terms(text)]
        scored = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n // volume
            scored.append((sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, w in weights if t in c), i))
        ranked = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1]))[:k]
        out += [(query_id, place + 1, i, score) for place, (score, i) in enumerate(ranked)]
    return sorted(out, key=repr)


def test_search_by_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["Straße", "É", "ΑΣ", "漢字"]
    posts = [(k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randint(0, 60)))) for k in range(300)]
    posts += [(1_000 + k, "w1 w2, W3! w30") for k in range(120)] + [(5, "w39 " * 9), (5, "w39 " * 9), (None, "w39 " * 9), (None, None), (2_000, ""), (2_001, "long w7 " * 40_000)]
    queries = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(25)]
    queries += [(0, "W1 w1 w39"), (100, None), (101, "..."), (102, "unheard"), (None, "é É 漢字 straße"), (103, "w7 long"), (104, "w39")]
    table = spark.createDataFrame(posts, "post_id long, content string").repartition(6)
    asked = spark.createDataFrame(queries, "query_id long, content string")
    for postings, n_queries in ((1 << 17, 1_000), (64, 16)):
        index = search.build_index(table, postings)
        found = search.search_posts(index, asked, 10, n_queries)
        assert sorted(map(tuple, found.collect()), key=repr) == brute_search(posts, queries, 10)
    sizes = [(len(r["post_ids"]), len(r["tfs"])) for r in index.blocks.collect()]
    assert all(volume <= 64 or n == 1 for n, volume in sizes) and len(sizes) > 60


def test_strata_hold_one_length_and_falling_counts(spark):
    rng = random.Random(6)
    posts = spark.createDataFrame([(k, "a " * rng.randint(1, 9) + "b " * rng.randint(0, 3)) for k in range(200)], "post_id long, content string")
    index = search.build_index(posts)
    counted = {r["post_id"]: Counter(r["content"].split()) for r in posts.collect()}
    volume = sum(sum(c.values()) for c in counted.values())
    for r in index.blocks.collect():
        assert {75 + 25 * sum(counted[i].values()) * 200 // volume for i in r["post_ids"]} == {r["m"]}
        for term, start, end in zip(r["terms"], r["starts"], [*r["starts"][1:], len(r["tfs"])]):
            tfs = r["tfs"][start:end]
            assert tfs == sorted(tfs, reverse=True)
            assert tfs == [counted[r["post_ids"][p]][bytes(term).decode()] for p in r["places"][start:end]]


def test_search_of_nothing(spark):
    posts, empty = edge_posts(spark).withColumnRenamed("_words", "term"), no_posts(spark)
    queries = spark.createDataFrame([("q", "plain text")], "query_id string, content string")
    assert search.rank_posts(empty, queries).count() == 0
    assert search.rank_posts(posts, queries.limit(0)).columns == ["query_id", "rank", "post_id", "score"]
    named = posts.withColumn("post_id", posts["post_id"].cast("string"))
    assert {r["post_id"] for r in search.rank_posts(named, queries).collect()} == {"1"}


def brute_negatives(rows, positives=5, negatives=3, scale=256):
    """``rows``: id, label, vector, anchor; in the order of ids, null last."""
    used = [(i, label, [math.floor(scale * x) for x in v], a) for i, label, v, a in rows
            if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    used.sort(key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for k, (i, label, v, anchor) in enumerate(used):
        if not anchor:
            continue
        order = sorted((-sum(x * y for x, y in zip(v, r[2])), j) for j, r in enumerate(used) if j != k)
        for ps, p in [x for x in order if used[x[1]][1] == label][:positives]:
            some = [x for x in order if used[x[1]][1] != label and 50 * -ps <= 100 * -x[0] <= 95 * -ps][:negatives]
            out += [(i, used[p][0], rank + 1, used[n][0], -ps, -ns) for rank, (ns, n) in enumerate(some)]
    return sorted(out, key=repr)


VECTORS = "post_id long, label string, vector array<double>, is_anchor boolean"


def mined(spark, rows, **kept):
    found = hard_negatives.mine_hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(5), **kept)
    return sorted(map(tuple, found.collect()), key=repr)


def test_negatives_by_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, rng.choice(["PASS", "FLAG", "BLOCK"]), [rng.gauss(0.2, 0.3) for _ in range(6)], k % 5 == 0) for k in range(200)]
    # copies of one vector under all labels, ties by id, rows repeated with one id
    rows += [(300 + k, ["PASS", "FLAG", "BLOCK"][k % 3], [0.5] * 6, k % 40 == 0) for k in range(150)]
    rows += [rows[0], rows[0], rows[1], (None, "PASS", [0.4] * 6, False), (None, "FLAG", [0.4] * 6, True)]
    rows += [(400, None, [0.1] * 6, True), (401, "PASS", None, True), (402, "PASS", [0.1, None], True), (403, "FLAG", [math.nan] * 6, False),
             (404, "FLAG", [math.inf] * 6, True), (405, "FLAG", [], True), (406, "PASS", [0.0] * 6, True), (407, "PASS", [0.9, 0.9], True), (408, "BLOCK", [0.1] * 6, None)]
    expected = brute_negatives(rows)
    assert len(expected) > 200 and mined(spark, rows) == expected
    # anchors in several blocks, scores in small steps
    monkeypatch.setattr(hard_negatives, "ANCHOR_VALUES", 100)
    monkeypatch.setattr(hard_negatives, "SCORES", 40)
    assert mined(spark, rows) == expected


def test_large_components_and_nothing(spark):
    rows = [(1, "a", [3e4, -3e4], True), (2, "a", [2.9e4, -3e4], False), (3, "b", [2.5e4, -2e4], False), (4, "b", [2e4, 1e4], False)]
    assert mined(spark, rows) == brute_negatives(rows)
    big = [(i, label, [x * 1e4 for x in v], a) for i, label, v, a in rows]
    assert mined(spark, big, scale=1) == brute_negatives(big, scale=1)
    assert {r[4] for r in mined(spark, [(i, label, [x * 1e9 for x in v], a) for i, label, v, a in rows])} <= {2**63 - 1}
    empty = spark.createDataFrame([], VECTORS + ", score long, row long")
    assert hard_negatives.mine_hard_negatives(empty).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mined(spark, [(1, "a", [1.0], True)]) == [] and mined(spark, [(1, "a", [1.0], False), (2, "b", [1.0], False)]) == []
    named = spark.createDataFrame([(f"p{i}", label, v, a, 1) for i, label, v, a in rows], VECTORS.replace("post_id long", "post_id string") + ", kind long")
    assert {r["anchor_id"] for r in hard_negatives.mine_hard_negatives(named).collect()} <= {"p1"}
