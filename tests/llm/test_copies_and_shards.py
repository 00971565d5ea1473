import hashlib
import random
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F
from tables import edge_posts, no_posts

from modsieve.llm import exact_dedup, sharding, shingles, simhash
from modsieve.llm.components import connected_components
from modsieve.llm.queries import op5_simhash
from modsieve.session import read_table, scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = WORD.findall(text)
    if not tokens:
        return 0
    shingles = [" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """Smallest id per connected row, ids given by order; all pairs."""
    names = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = names[i], names[j]
                names = [min(a, b) if n in (a, b) else n for n in names]
    return names


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_simhash_query_by_brute_force(spark, small):
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, small, "documents").collect()}
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[i]) for i in ids]
    names = brute_components(prints)
    rows = {r["doc_id"]: r for r in op5_simhash(spark, small).collect()}
    assert len(rows) == len(ids)
    for k, i in enumerate(ids):
        assert (rows[i]["fingerprint"], rows[i]["component_id"]) == (f"{prints[k]:016x}", ids[names[k]])


def test_links_lose_nothing(spark):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:30]:
        for flips in (1, 2, 2, 3):
            q = p
            for bit in rng.sample(range(64), flips):
                q ^= 1 << bit
            prints.add(q)
    # one hot neighbourhood: all values one bit from one value
    hot = rng.getrandbits(64)
    prints |= {hot ^ (1 << b) for b in range(64)}
    prints = sorted(prints)
    links = simhash.fingerprint_links(spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")).collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in links)
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    names = brute_components(prints)
    groups, mine = {}, {}
    for k, p in enumerate(prints):
        groups.setdefault(names[k], set()).add(signed(p))
        mine.setdefault(found.get(signed(p), signed(p)), set()).add(signed(p))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def word_sets(texts, words=5):
    found = []
    for text in texts:
        tokens = (text or "").encode().lower().split()
        found.append({b" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))} if tokens else set())
    return found


def brute_groups(texts):
    """Smallest place per text over links of at least 0.8, all pairs."""
    sets = word_sets(texts)
    names = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                a, b = names[i], names[j]
                names = [min(a, b) if n in (a, b) else n for n in names]
    return names


def test_shingle_groups_by_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for size in (3, 30, 120, 400, 9_000):
        base = [f"w{rng.randrange(5_000)}" for _ in range(size)]
        texts += [" ".join(base)] * 2
        for changed in (1, size // 60, size // 45, size // 30, size // 10):
            other = list(base)
            for place in rng.sample(range(size), min(size, changed)):
                other[place] = f"x{rng.randrange(5_000)}"
            texts.append(" ".join(other))
    # a group larger than what is compared all with all, a chain, and contents without words
    base = [f"h{k}" for k in range(100)]
    texts += [" ".join([*base, f"end{k}"]) for k in range(150)]
    texts += [" ".join(f"c{k}" for k in range(5 * step, 5 * step + 100)) for step in range(12)]
    texts += [None, "", " \n "]
    names = brute_groups(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "post_id long, content string")
    kept = sorted(r["post_id"] for r in shingles.keep_one(rows).collect())
    assert kept == [k for k, n in enumerate(names) if n == k]
    assert shingles.keep_one(no_posts(spark)).count() == 0
    once = shingles.keep_one(edge_posts(spark))
    assert once.columns == edge_posts(spark).columns and once.filter("post_id in (2, 3, 4)").count() == 1 and once.filter("post_id = 1").count() == 1


def test_long_chain_is_one_component(spark):
    links = spark.range(400).selectExpr("id + 1 as a", "id as b")
    assert {r["root"] for r in connected_components(links).collect()} == {0}


def test_simhash_edge_posts(spark):
    rows = simhash.near_copies(edge_posts(spark)).collect()
    assert len(rows) == 11
    zero = [r for r in rows if r["fingerprint"] == 0]
    assert {r["post_id"] for r in zero} >= {2, 3, 4} and {r["component_id"] for r in zero} == {2}
    for r in rows:
        text = next(e[1] for e in edge_posts(spark).collect() if e[0] == r["post_id"])
        assert r["fingerprint"] & (1 << 64) - 1 == brute_fingerprint(text)
    assert simhash.near_copies(no_posts(spark)).count() == 0


def test_segments_find_candidates_that_are_rejected(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(40)}
    # one half alike: candidates whose complete distance is large; some of them are links
    for p in list(prints)[:10]:
        for _ in range(4):
            prints.add(p & 0xFFFFFFFF | rng.getrandbits(32) << 32)
            prints.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    # a crowded bucket: hundreds of fingerprints with one half in common, links among them
    half = rng.getrandbits(32)
    crowd = [half << 32 | rng.getrandbits(32) for _ in range(300)]
    prints |= set(crowd) | {p ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32)) for p in crowd[:60]} | {p ^ (1 << 63) ^ (1 << rng.randrange(32)) for p in crowd[:60]}
    prints = sorted(prints)
    want = {tuple(sorted((signed(p), signed(q)), reverse=True)) for k, p in enumerate(prints) for q in prints[:k] if (p ^ q).bit_count() <= 2}
    table = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    pairs = []
    for hot in (10_000, 20):
        pairs.append({(r["a"], r["b"]) for r in simhash.candidates(table, hot).collect()})
        assert want < pairs[-1] and len(pairs[-1]) - len(want) > 100
    # the split compares far fewer of the crowd, and loses no link
    assert len(pairs[1]) < len(pairs[0]) / 3
    assert {(r["a"], r["b"]) for r in simhash.fingerprint_links(table).collect()} == want


def test_index_over_batches(spark):
    schema = "post_id long, content string"
    location = scratch_path(spark, "index")
    index = exact_dedup.DigestIndex(spark, location, buckets=4)
    first = exact_dedup.dedup(spark.createDataFrame([(5, "a b"), (3, "a \n b"), (4, None), (9, "c")], schema), index).collect()
    assert {(r["post_id"], r["keep_id"], r["kept"], r["group_size"]) for r in first} == {(5, 3, False, 2), (3, 3, True, 2), (4, 4, True, 1), (9, 9, True, 1)}
    index.close()
    # a later session opens the same files under another name
    again = exact_dedup.DigestIndex(spark, location, buckets=4)
    second = exact_dedup.dedup(spark.createDataFrame([(1, "a\tb"), (2, ""), (8, "new"), (7, "new")], schema), again).collect()
    assert {(r["post_id"], r["keep_id"], r["kept"]) for r in second} == {(1, 3, False), (2, 4, False), (8, 7, False), (7, 7, True)}
    rows = spark.table(again.table).collect()
    assert len(rows) == len({bytes(r["digest"]) for r in rows}) == 4


def test_anti_join_keeps_the_buckets(spark):
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "index"), buckets=8)
    groups = spark.createDataFrame([(b"x", 1)], "digest binary, post_id long")
    plan = groups.join(index.open().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 2


def test_dedup_edge_posts(spark):
    rows = exact_dedup.dedup(edge_posts(spark), exact_dedup.new_index(spark)).collect()
    assert len(rows) == 11
    for r in rows:
        assert len(r["digest"]) == 32
    by_digest = {}
    for r, e in zip(sorted(rows, key=lambda r: (r["post_id"] is None, r["post_id"])), sorted(edge_posts(spark).collect(), key=lambda r: (r[0] is None, r[0]))):
        assert bytes(r["digest"]) == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", e["content"] or "").encode()).digest()
        by_digest.setdefault(bytes(r["digest"]), []).append(r)
    for group in by_digest.values():
        ids = [r["post_id"] for r in group if r["post_id"] is not None]
        assert {(r["keep_id"], r["group_size"]) for r in group} == {(min(ids, default=None), len(group))}
    assert exact_dedup.dedup(no_posts(spark), exact_dedup.new_index(spark)).count() == 0
    assert exact_dedup.keep_first(edge_posts(spark), exact_dedup.new_index(spark)).columns == edge_posts(spark).columns


def test_one_physical_row_of_every_group(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "twice the same file"), (1, "twice the same file"), (2, "twice  the same file"), (None, "no id"), (None, "no id"), (None, "no id"),
            (3, long), (3, "another text under id three"), (2, long), (None, long), (2, long)]
    table = spark.createDataFrame(rows, "post_id long, content string").repartition(3)
    want = [(1, "twice the same file"), (2, long), (3, "another text under id three"), (None, "no id")]
    kept = exact_dedup.keep_first(table, exact_dedup.new_index(spark))
    assert sorted(map(tuple, kept.collect()), key=lambda r: (r[0] is None, r[0] or 0)) == want


def test_copies_of_posts_with_generated_ids(spark):
    rows = [("post_b_2", "the same"), ("post_a_1", "the  same"), ("post_c_3", None), (None, "the same"), ("post_d_4", "")]
    table = spark.createDataFrame(rows, "post_id string, content string")
    tables = spark.catalog.listTables()
    index = exact_dedup.new_index(spark)
    found = {r["post_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(table, index).collect()}
    index.close()
    assert found == {"post_a_1": ("post_a_1", 3, True), "post_b_2": ("post_a_1", 3, False), None: ("post_a_1", 3, False),
                     "post_c_3": ("post_c_3", 2, True), "post_d_4": ("post_c_3", 2, False)}
    index = exact_dedup.new_index(spark)
    kept = exact_dedup.keep_first(table, index)
    index.close()
    assert sorted(map(tuple, kept.collect())) == [("post_a_1", "the  same"), ("post_c_3", None)]
    assert spark.catalog.listTables() == tables


def test_permutation_and_back():
    for n in (1, 2, 3, 5, 64, 100, 1_000, 65_537):
        places = sharding.permute(np.arange(n), n, seed=9)
        assert sorted(places.tolist()) == list(range(n)) and (sharding.restore(places, n, seed=9) == np.arange(n)).all()
    assert not (sharding.permute(np.arange(1_000), 1_000, 1) == sharding.permute(np.arange(1_000), 1_000, 2)).all()
    assert abs(np.corrcoef(np.arange(65_537), sharding.permute(np.arange(65_537), 65_537, 3))[0, 1]) < 0.02


def test_shards_of_edge_posts(spark):
    for shards in (1, 3, 16):
        rows = sharding.shard_posts(edge_posts(spark), shards, seed=4).collect()
        assert len(rows) == 11 and sorted(r["row_number"] for r in rows) == list(range(11))
        for s in range(min(shards, 11)):
            slots = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert slots == list(range(len(slots))) and len(slots) in (11 // shards, -(-11 // shards))
        back = sharding.restore(np.array([r["slot"] * shards + r["shard"] for r in rows]), 11, 4)
        assert back.tolist() == [r["row_number"] for r in rows]
    content = {e["post_id"]: e["content"] or "" for e in edge_posts(spark).collect()}
    for r in rows:
        raw = content[r["post_id"]].encode()
        assert (r["size"], r["content_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.shard_posts(no_posts(spark), 16).count() == 0
    again = sharding.shard_posts(edge_posts(spark).repartition(5), 16, seed=4).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)


def test_shingle_stage_takes_the_pairs_of_simhash(spark, monkeypatch):
    # no two texts share a band here: only fingerprints can find the copy
    words = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, "quite another text of its own words")]
    posts = spark.createDataFrame(rows, "post_id long, content string")
    monkeypatch.setattr(shingles, "shared_entries", lambda nodes: nodes.select("node", F.explode("bands").alias("entry"), F.lit(2).cast("long").alias("n")).limit(0))
    nodes = shingles.signatures(posts.select(F.col("post_id").alias("_id"), F.lit(b"").alias("_digest"), "content"))
    prints = {r["_id"]: r["fingerprint"] & (2**64 - 1) for r in nodes.collect()}
    assert (prints[1] ^ prints[2]).bit_count() <= 2 < (prints[1] ^ prints[3]).bit_count()
    assert sorted(r["post_id"] for r in shingles.keep_one(posts).collect()) == [1, 3]


def test_crowded_bands_lose_no_link(spark, monkeypatch):
    # 600 texts share a long passage and are apart, 40 of them have a near copy; groups of two compare few of an entry's members
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(120)]
    own = [[f"o{k}x{w}" for w in range(36 + k % 9)] for k in range(600)]
    copies = [[*own[k][:-6], *(f"c{k}x{w}" for w in range(6))] for k in range(0, 600, 15)]
    rows = [(k, " ".join(passage + words)) for k, words in enumerate(own + copies)]
    rng.shuffle(rows)
    texts = dict(rows)
    sets = {k: set(shingles.shingle_hashes(t).tolist()) for k, t in texts.items()}
    links = {(a, b) for a in sets for b in sets if a > b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links == {(600 + k, 15 * k) for k in range(40)}
    monkeypatch.setattr(shingles, "GROUP", 2)
    posts = spark.createDataFrame(rows, "post_id long, content string")
    assert sorted(r["post_id"] for r in shingles.keep_one(posts).collect()) == list(range(600))


def test_crowd_pairs_hold_all_that_are_alike(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), 1 << 63, 60)
    sets = []
    for size in rng.integers(1, 61, 150):
        some = np.concatenate([rng.choice(base, size, replace=False), rng.integers(-(1 << 63), 1 << 63, rng.integers(0, 12))])
        sets.append(np.unique(some.view(np.uint64)).view(np.int64).tolist())
    sets += [base[:59].tolist(), base.tolist(), base[1:].tolist(), [5], [5, 6], [7]]
    roots = [k if k % 3 else 0 for k in range(len(sets))]
    table = spark.createDataFrame(list(zip(range(len(sets)), roots, sets)), "node long, root long, hashes array<bigint>").repartition(5)
    want = {(a, b) for a in range(len(sets)) for b in range(a) if roots[a] != roots[b]
            and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    for group in (1, 32):
        monkeypatch.setattr(shingles, "GROUP", group)
        found = {(r["a"], r["b"]) for r in shingles.crowd_pairs(table).collect()}
        assert len(want) > 10 and want <= found and all(roots[a] != roots[b] for a, b in found) and len(found) < 3 * len(want)


def inner_broadcasts(frame):
    """Inner joins of the plan that broadcast a side."""
    return re.findall(r"BroadcastHashJoin.*Inner.*", frame._jdf.queryExecution().sparkPlan().toString())


def test_balls_of_fingerprints_are_not_broadcast(spark):
    # small enough for Spark to broadcast it, if it counts 66 rows of a fingerprint as one
    prints = spark.range(300).select(F.xxhash64("id").alias("fingerprint")).union(spark.range(5).select(F.col("id").alias("fingerprint")))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20
    assert inner_broadcasts(simhash.candidates(prints)) == []
    assert inner_broadcasts(simhash.candidates(prints, hot=2)) == []


def test_counts_of_entries_and_rows_that_stay_are_not_broadcast(spark):
    nodes = spark.range(300).select(F.col("id").alias("node"), F.array(F.lit(1).cast("long"), F.col("id")).alias("bands"))
    assert inner_broadcasts(shingles.shared_entries(nodes)) == []
    posts = spark.range(50).select(F.col("id").alias("post_id"), F.concat(F.lit("text "), F.col("id")).alias("content"))
    kept = shingles.keep_one(posts)
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().sparkPlan().toString() and kept.count() == 50
