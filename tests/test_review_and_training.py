import datetime

import pytest
from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.operators import learning as ML
from modsieve.operators import review as V
from modsieve.operators import training as T
from modsieve.plans import catalog, fixtures
from modsieve.session import read_table

T0 = datetime.datetime(2024, 1, 1)
POSTS = "post_id long, accepted boolean, action string, override string, comments string, reason string, decision string"


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def test_last_override_wins_and_can_be_taken_back(spark):
    posts = spark.createDataFrame([(i, True, "PASS", "No", None, "r", "ACCEPT") for i in range(5)]
                                  + [(5, False, "FLAG_MEDIUM", "No", None, "r", "ESCALATE")], POSTS)
    commands = spark.createDataFrame([
        (0, "Rejected", at(1), 1), (0, "Flagged", at(2), 2),
        (1, "Rejected", at(1), 3), (1, "Accepted", at(1), 4),   # same time: higher seq; back to the original
        (2, "Maybe", at(9), 5), (2, "Rejected", at(1), 6),      # unknown value never counts
        (5, "Flagged", at(1), 7), (9, "Accepted", at(1), 8),
    ], "post_id long, override_value string, ts timestamp, seq long")
    got = {r.post_id: (r.override, r.accepted, r.action) for r in V.override_apply(posts, commands).collect()}
    assert got == {0: ("Yes", False, "FLAG_MEDIUM"), 1: ("No", True, "PASS"), 2: ("Yes", False, "BLOCK"),
                   3: ("No", True, "PASS"), 4: ("No", True, "PASS"), 5: ("No", False, "FLAG_MEDIUM")}
    assert [r.post_id for r in V.not_found(commands, posts).collect()] == [9]
    assert [r.seq for r in V.override_rejects(commands).collect()] == [5]
    # an override of an overridden row is judged by the engine's decision; null values are rejects
    again = spark.createDataFrame([(0, "Accepted", at(5), 10), (2, "Flagged", at(5), 11), (3, None, at(5), 12)], "post_id long, override_value string, ts timestamp, seq long")
    stored = V.override_apply(posts, commands)
    got = {r.post_id: (r.override, r.accepted, r.action) for r in V.override_apply(stored, again).collect()}
    assert got[0] == ("No", True, "PASS") and got[2] == ("Yes", False, "FLAG_MEDIUM") and got[3] == ("No", True, "PASS") and got[1] == ("No", True, "PASS")
    assert [r.seq for r in V.override_rejects(again).collect()] == [12]
    with pytest.raises(ValueError):
        V.override_apply(posts.drop("decision"), commands)
    fresh = V.restore_decision(posts.drop("decision"), posts.select("post_id", "decision"))
    assert V.override_apply(fresh, commands).count() == 6


def test_comments_replace_and_long_ones_are_rejected(spark):
    posts = spark.createDataFrame([(i, True, "PASS", "No", "old", "r", "ACCEPT") for i in range(3)], POSTS)
    commands = spark.createDataFrame([(0, "a", at(1), 1), (0, "b", at(2), 2), (1, "x" * 501, at(3), 3), (1, "y" * 500, at(1), 4)],
                                     "post_id long, comments string, ts timestamp, seq long")
    got = {r.post_id: r.comments for r in V.comments_apply(posts, commands).collect()}
    assert got == {0: "b", 1: "y" * 500, 2: "old"}
    assert [r.seq for r in V.comment_rejects(commands).collect()] == [3]


def test_lookup(spark):
    posts = spark.createDataFrame([(i, True, "PASS", "No", None, "r", "ACCEPT") for i in range(3)], POSTS)
    assert V.post_by_id(posts, 2).count() == 1 and V.post_by_id(posts, 7).count() == 0


def test_lines(spark):
    df = spark.createDataFrame([(1, "1. Hello. World\n\n---\r\n2. Bye\n3)no dot\n7.\n")], "id int, response string")
    assert [r.text for r in T.parse_lines(df).orderBy("line_no").collect()] == ["Hello. World", "Bye", "3)no dot"]


def test_dedup_keeps_the_first_and_is_stable(spark):
    rows = [(i, "Same, text!" if i % 3 else ("same TEXT" if i % 2 else f"text {i}")) for i in range(300)] + [(900, "!!!"), (901, "???")]
    df = spark.createDataFrame(rows, "id long, text string")
    once = T.dedup_keep_first(df)
    kept = sorted(r.id for r in once.collect())
    assert 1 in kept and 2 not in kept and 3 not in kept and 900 in kept and 901 not in kept
    assert sorted(r.id for r in T.dedup_keep_first(once).collect()) == kept


def test_noise(spark):
    row = spark.createDataFrame([("missing Apple", 2), ("missing Apple", 1)], "t string, c long").select(
        T.noise_typo(F.col("t"), F.col("c")), T.noise_dollar(F.col("t")), T.noise_case(F.col("t"), F.col("c")),
        T.noise_hashtag(F.col("t"), F.col("c")), T.noise_suffix(F.col("t"), F.col("c"))).collect()
    assert tuple(row[0]) == ("mixssing Apple", "mi$sing Apple", "missing apple", "missing Apple #scamalert", "missing Apple!!")
    assert row[1][0] == "missing Apple" and row[1][2] == "MISSING APPLE"


def test_training_set_properties(spark, small):
    rows = fixtures.training(spark, small)
    built = T.build_training_set(fixtures.training_choices(rows), fixtures.rewrites(rows), {"PASS": 30, "FLAG": 20, "BLOCK": 10**6})
    counts = {r.label: r["count"] for r in built.groupBy("label").count().collect()}
    assert counts["PASS"] == 30 and counts["FLAG"] == 20 and counts["BLOCK"] > 50
    assert T.dedup_keep_first(built, groups=["label"]).count() == built.count()
    assert built.filter(F.col("id") >= 200).count() > 0  # paraphrases or noise got in


def test_augmented_rows_survive_a_binding_quota(spark):
    # more distinct posts than the quota, half of the first ones copies: their places go to paraphrases and noise
    rows = spark.range(2_000).selectExpr("id", "concat('Some post text ', if(id < 100, id % 20, id)) as text", "'PASS' as label")
    rewrites = rows.selectExpr("id", "concat('In other words: ', id) as rewrite")
    built = T.build_training_set(fixtures.training_choices(rows), rewrites, {"PASS": 100}).collect()
    # 20 distinct base posts, 25 paraphrases, noise of a fifth of 125
    kinds = [sum(lo <= r.id < lo + 100 for r in built) for lo in (0, 100, 200)] + [sum(r.id >= 300 for r in built)]
    assert kinds[:2] == [20, 25] and sum(kinds) == len(built) <= 70 and kinds[2] + kinds[3] > 0
    assert [r.id for r in built] != sorted(r.id for r in built)


def test_quota_of_any_size_is_one_plan(spark):
    rows = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 'PASS', 'BLOCK') as label")
    assert T.within_quota(rows, {"PASS": 5_000, "BLOCK": 3}).groupBy("label").count().orderBy("label").collect() == [("BLOCK", 3), ("PASS", 5_000)]


def test_folds_are_even(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") % 7 == 0, "FLAG").otherwise("PASS").alias("label"))
    sizes = ML.stratified_folds(df).groupBy("label", "fold").count().collect()
    for label in ("FLAG", "PASS"):
        got = [r["count"] for r in sizes if r.label == label]
        assert len(got) == 5 and max(got) - min(got) <= 1


@pytest.fixture(scope="module")
def learnable(spark):
    """Texts whose class shows in the features."""
    kinds = [("PASS", "hello dear friend number {}"), ("FLAG", "crypto?? tip {}"), ("BLOCK", "ACT NOW guaranteed returns 200% return {}")]
    rows = [(i, kinds[i % 3][1].format(i), kinds[i % 3][0]) for i in range(240)]
    return spark.createDataFrame(rows, "id long, text string, label string")


@pytest.mark.parametrize("family,params", [("forest", {"numTrees": 10}), ("logistic", {"maxIter": 20}), ("gbt", {"maxIter": 3})])
def test_train_store_load_score(spark, learnable, tmp_path, family, params):
    held = learnable.filter("id % 4 = 0")
    bundle = ML.train_classifier(ML.training_features(learnable.filter("id % 4 <> 0")), family, **params)
    bundle.save(str(tmp_path / family))
    back = ML.ClassifierBundle.load(str(tmp_path / family))
    posts = held.select("id", F.col("text").alias("content"), "label")
    scored = back.score(posts)
    best = F.element_at(F.array(*[F.lit(x) for x in K.CLASS_LABELS]), F.array_position("class_probs", F.array_max("class_probs")).cast("int"))
    right = scored.filter(best == F.col("label")).count()
    assert right > 0.9 * held.count()
    a = {r.id: list(r.class_probs) for r in bundle.score(posts).collect()}
    assert a == {r.id: list(r.class_probs) for r in scored.collect()}
    assert all(abs(sum(p) - 1) < 1e-9 for p in a.values())
    top = ML.top_features(back.importances(spark)).collect()
    assert len(top) == 20 and top[0].importance >= top[-1].importance
    assert ML.ClassifierBundle.load(str(tmp_path / "nothing")) is None


def test_search_picks_the_best_setting(spark, learnable):
    made = ML.training_features(learnable)
    best, settings = ML.random_search(ML.assemble(made.frame, made.names, "id", "label"), "logistic", draws=3, folds=3, fixed={"maxIter": 10})
    assert len(settings) == 3 and max(best.avgMetrics) > 0.9
    assert ML.draw_settings("forest", 30) == ML.draw_settings("forest", 30) and len(ML.draw_settings("forest", 30)) == 30


def test_bundles_are_scored_in_one_pass(spark, learnable, monkeypatch):
    made, half = ML.training_features(learnable), ML.training_features(learnable.filter("id < 60"))
    bundles = {"a": ML.train_classifier(made, "logistic", maxIter=5), "b": ML.train_classifier(half, "logistic", maxIter=5), "c": ML.train_classifier(made, "forest", numTrees=3)}
    assert made.vocab != half.vocab
    posts = learnable.select("id", F.col("text").alias("content"))
    posts = posts.union(posts.limit(7))
    alone = {name: sorted((r.id, *r.class_probs) for r in bundle.score(posts).collect()) for name, bundle in bundles.items()}
    cuts, cut = [], ML.scoring_features
    monkeypatch.setattr(ML, "scoring_features", lambda *a, **k: cuts.append(1) or cut(*a, **k))
    scored = ML.scored_by(posts, bundles)
    rows = scored.collect()
    assert scored.columns == ["id", "content", "a", "b", "c"] and len(cuts) == 2 and len(rows) == 247
    assert all(sorted((r.id, *r[name]) for r in rows) == alone[name] for name in bundles)


def test_model_artifact_has_a_row_for_every_post(spark, small, tmp_path):
    docs = read_table(spark, small, "documents")
    docs.union(docs.limit(5)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.load()[0]["model_artifact"](spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() + 5 and all(r.same_scores for r in rows)
