import pandas as pd
import pytest
from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.operators import cascade as C
from modsieve.operators import moderate
from modsieve.operators import stages as S
from modsieve.operators.explanations import parse_explanation
from modsieve.operators.providers import batch_scorer, masked
from modsieve.plans import fixtures
from modsieve.sources import posts as P


def run(spark, rows):
    """rows: content, probs, (label, score, error), (sentiment, score, error), response"""
    schema = ("post_id int, content string, class_probs array<double>, toxicity struct<label:string,score:double,error:string>, "
              "sentiment struct<label:string,score:double,error:string>, verdict_response string")
    posts = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    done = moderate.default_cascade().run(posts)
    return [(r.outcome, r.trace) for r in done.orderBy("post_id").collect()]


CALM = [0.8, 0.1, 0.1]
CASES = [
    (("a scammer", CALM, None, None, "CLEAN"), (K.STAGE_RULES, "BLOCK", "lexical_rule: scammer", 0.9, "high")),
    (("pay $500", CALM, None, None, "CLEAN"), (K.STAGE_RULES, "BLOCK", "lexical_rule: crypto_address", 0.8, "medium")),
    (("hi", [0.1, 0.2, 0.7], None, None, "CLEAN"), (K.STAGE_CLASSIFIER, "BLOCK", "lgbm_flagged_block", 0.7, "high")),
    (("hi", CALM, ("TOXIC", 0.9, None), None, "CLEAN"), (K.STAGE_TOXICITY, "BLOCK", "toxicity: 0.900", 0.9, "high")),
    (("hi", CALM, ("label_1", 0.8, None), None, "CLEAN"), (K.STAGE_TOXICITY, "BLOCK", "toxicity: 0.800", 0.8, "medium")),
    (("hi", CALM, ("toxic", 0.5, None), None, "CLEAN"), (K.STAGE_TOXICITY, "BLOCK", "toxicity: 0.500", 0.5, "medium")),
    (("hi", CALM, ("other", 0.99, None), None, "CLEAN"), (K.STAGE_VERDICT, "ACCEPT", "llm: clean_cot", 0.9, "low")),
    (("see http://x", CALM, None, None, None), (K.STAGE_VERDICT, "BLOCK", "llm: fallback_escalated_content", 0.7, "medium")),
    (("hi", [0.1, 0.8, 0.1], None, None, None), (K.STAGE_VERDICT, "BLOCK", "llm: fallback_escalated_content", 0.7, "medium")),
    (("hi", CALM, None, None, None), (K.STAGE_VERDICT, "ACCEPT", "llm: fallback_no_escalation", 0.6, "low")),
    (("hi", None, None, None, "not fraud"), (K.STAGE_VERDICT, "BLOCK", "llm: fraud_detected_cot", 0.9, "high")),
    (("hi", CALM, ("x", None, "boom"), ("negative", 0.95, None), " clean "), (K.STAGE_VERDICT, "ACCEPT", "llm: clean_cot", 0.9, "low")),
    (("hi", CALM, None, None, "hm"), (K.STAGE_VERDICT, "BLOCK", "llm: uncertain_cot", 0.5, "medium")),
    (("hi", [0.4, 0.2, 0.4], None, None, "CLEAN"), (K.STAGE_VERDICT, "ACCEPT", "llm: clean_cot", 0.9, "low")),
    (("hi", [0.2, 0.4, 0.4], None, None, None), (K.STAGE_VERDICT, "BLOCK", "llm: fallback_escalated_content", 0.7, "medium")),
]


def test_every_reachable_outcome(spark):
    for (outcome, trace), (_, want) in zip(run(spark, [c for c, _ in CASES]), CASES):
        assert (outcome.stage, outcome.decision, outcome.reason, round(outcome.confidence, 9), outcome.threat_level) == want
        names = [s.stage for s in trace]
        assert names == K.STAGE_ORDER[: len(names)] and names[-1] == outcome.stage
        assert all(s.decision != "BLOCK" for s in trace[:-1])


def test_intermediate_results(spark):
    (_, trace), (_, second) = run(spark, [
        ("see http://x", None, ("toxic", 0.1, None), ("negative", 0.95, None), "CLEAN"),
        ("hi", CALM, ("toxic", 0.9, "boom"), ("negative", 0.8, None), "CLEAN")])
    assert [s.reason for s in trace[:4]] == [
        "lexical_rule: suspicious_url", "lgbm_model_unavailable", "toxicity: passed", "sentiment_warning: highly_negative_0.950"]
    assert abs(trace[2].confidence - 0.9) < 1e-12 and trace[3].metadata == {"sentiment": "negative", "sentiment_confidence": "0.95"}
    assert [s.reason for s in second[1:4]] == ["lgbm_passed", "toxicity: error", "sentiment: negative_0.800"]


def test_stored_trace_resolves_the_same_way(spark, small):
    done = fixtures.decided(spark, small)
    assert done.filter(C.resolve(F.col("trace"))["reason"] != F.col("outcome")["reason"]).count() == 0
    empty = spark.range(1).select(C.resolve(F.array().cast(f"array<{S.RESULT_TYPE}>")).alias("o")).first().o
    assert (empty.stage, empty.reason) == ("pipeline", "all_stages_passed")


def test_fixture_reaches_every_branch(spark, small):
    trace = C.stage_trace(fixtures.decided(spark, small), "post_id")
    seen = {r.reason.split("_0.")[0].split(": 0.")[0] for r in trace.select("reason").distinct().collect()}
    assert {"lgbm_flagged_block", "lgbm_flagged_flag", "lgbm_passed", "lgbm_model_unavailable", "toxicity", "toxicity: error",
            "toxicity: passed", "toxicity: model_unavailable", "sentiment: error", "sentiment: model_unavailable",
            "sentiment_warning: highly_negative", "llm: fallback_escalated_content", "llm: fallback_no_escalation",
            "llm: fraud_detected_cot", "llm: clean_cot", "llm: uncertain_cot"} <= seen


def test_scorer_never_sees_blocked_posts(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def load():
        def model(texts: pd.Series) -> pd.DataFrame:
            with open(calls, "a") as out:
                out.write("".join(f"{t}\n" for t in texts))
            return pd.DataFrame({"label": ["toxic"] * len(texts), "score": [0.9] * len(texts), "error": [None] * len(texts)})

        return model

    score = batch_scorer(load, "label string, score double, error string")
    posts = spark.createDataFrame([(i, "scammer" if i % 2 else f"calm {i}") for i in range(100)], "post_id int, content string")
    rules = S.rules_stage()
    first = rules.prepare(posts)
    first = first.withColumn("rules", rules.decide(first, []))
    scored = first.withColumn("toxicity", score(masked(F.col("content"), [F.col("rules")])))
    got = C.Cascade([moderate.from_column("rules", K.STAGE_RULES), S.toxicity_stage()]).run(scored)
    counts = {r.stage: r["count"] for r in got.groupBy(F.col("outcome")["stage"].alias("stage")).count().collect()}
    assert counts == {K.STAGE_RULES: 50, K.STAGE_TOXICITY: 50}
    asked = open(calls).read().split("\n")[:-1]
    assert len(asked) == 50 and all(t.startswith("calm") for t in asked)


@pytest.mark.parametrize("response,error,want", [
    ('x {"explanation": "e", "troublesome_words": ["a"], "suggestion": "s"} y', None, ("e", ["a"], "s")),
    ('{"explanation": "e"}', None, ("e", [], "")), ("plain", None, ("plain", [], "")), ("{bad}", None, ("{bad}", [], "")),
    ("} {", None, ("} {", [], "")), (None, None, (K.EXPLANATION_FAILED, [], "")), ("{}", "quota", ("quota", [], "")),
    ("{}", None, ("", [], "")),
])
def test_explanations(spark, response, error, want):
    df = spark.createDataFrame([(response, error)], "r string, e string")
    assert tuple(df.select(parse_explanation(F.col("r"), F.col("e")).alias("a")).first().a) == want


def test_contents_stay_out_of_the_shuffle(spark, small):
    """Flagged-only and narrow outputs: no exchange below the decisions carries the content."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fixtures.decided(spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [line for line in plan.splitlines() if "Exchange" in line]
    assert lines and "content" not in fixtures.decided(spark, small).columns
    for line, below in zip(plan.splitlines(), plan.splitlines()[1:]):
        if "Exchange hashpartitioning" in line and "Project [" in below:
            # output names only: what a projection computes from the content stays below
            shown = [part.split(" AS ")[-1] for part in below.split("Project [", 1)[1].split(", ")]
            assert not any(name.startswith("content#") for name in shown)


def test_requests_only_for_flagged_posts(spark):
    posts = spark.createDataFrame([(1, "a scammer wrote"), (2, "fine words")], "post_id long, content string")
    toxicity = spark.createDataFrame([], "post_id long, label string, score double, error string")
    decided = moderate.decide(posts, toxicity, text_scores=lambda p: p.withColumn("verdict_response", F.lit("CLEAN")))
    asked = moderate.explanation_requests(posts, decided).collect()
    assert [r.post_id for r in asked] == [1] and "a scammer wrote" in asked[0].prompt


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        import os
        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")
        return lambda texts: pd.DataFrame({"n": texts.str.len()})

    score = batch_scorer(load, "n long")
    posts = spark.range(0, 64, 1, 16).select(F.col("id").cast("string").alias("content"))
    assert posts.select(score("content")["n"].alias("n")).agg(F.sum("n")).first()[0] == 10 + 2 * 54
    pids = open(log).read().split()
    assert len(pids) == len(set(pids))


def test_csv_to_records_and_report(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text('content,who\n"a scammer, really",x\n"  ",y\n"two\nlines",z\n')
    (folder / "b.csv").write_text("content,who\nfine,x\nfine,x\nmake $5000 at https://a.b,y\n")
    record, report = moderate.analyse_csv(spark, str(folder), F.lit("2024-02-01T00:00:00"))
    rows = {r.post_id: r for r in record.collect()}
    assert {k: r.full_content for k, r in rows.items()} == {
        "post_1": "a scammer, really", "post_2": "two\nlines", "post_3": "fine", "post_4": "fine", "post_5": "make $5000 at https://a.b"}
    assert len(record.columns) == 17 and rows["post_3"].accepted and not rows["post_1"].accepted
    assert report.first()["performance"]["total_posts"] == 5 if "total_posts" in report.first()["performance"].asDict() else report.count() == 1
    named, _ = moderate.analyse_csv(spark, str(folder / "b.csv"), F.lit("2024-02-01T00:00:00"), id_column="who")
    assert sorted(r.post_id for r in named.collect()) == ["x", "x", "y"]


def test_numbers_by_position_move_no_content(spark, tmp_path):
    for k in range(3):
        spark.range(k * 1_000, k * 1_000 + 1_000, 1, 1).selectExpr("id", "concat('text ', id) as content").write.parquet(str(tmp_path / f"p{k}"))
    posts = spark.read.parquet(*[str(tmp_path / f"p{k}") for k in range(3)])
    named = P.assign_post_id(P.skip_empty(posts), position=True)
    plan = named._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert all("SinglePartition" in line for line in moved) and "content" not in "".join(moved)
    found = {r.id: int(r.post_id[5:]) for r in named.collect()}
    assert found == {k: k + 1 for k in range(3_000)}
    assert found == {r.id: int(r.post_id[5:]) for r in P.assign_post_id(posts, position=True).collect()}


def test_stored_posts_are_not_shuffled(spark, tmp_path):
    posts = spark.range(200).selectExpr("id as post_id", "concat('act now guaranteed returns ', id) as content")
    toxicity = spark.range(0, 200, 2).selectExpr("id as post_id", "'toxic' as label", "0.9D as score", "cast(null as string) as error")
    want = sorted(map(str, moderate.decide(posts, toxicity, keep_content=True).collect()))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = P.store_posts(posts, "stored_posts", str(tmp_path / "posts"), 4)
        scores = P.store_posts(toxicity, "stored_scores", str(tmp_path / "scores"), 4)
        decided = moderate.decide(stored, scores, keep_content=True)
        kept = P.store_posts(decided.drop("content"), "stored_decisions", str(tmp_path / "decisions"), 4)
        for frame in (decided, moderate.explanation_requests(stored, kept)):
            assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, decided.collect())) == want and moderate.explanation_requests(stored, kept).count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in ("stored_posts", "stored_scores", "stored_decisions"):
            spark.sql(f"drop table if exists {name}")


def test_text_model_skips_blocked_posts(spark):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(texts):
            calls.add(len(texts))
            return pd.DataFrame({"score": texts.str.len().astype(float)})
        return model

    rows = spark.createDataFrame([(1, "abc", "ACCEPT"), (2, "de", "BLOCK"), (3, "f" * 100_000, "ESCALATE"), (4, None, "ACCEPT")], "post_id long, content string, decision string")
    score = batch_scorer(load, "score double, seconds double", timed="seconds")
    found = {r.post_id: r.m for r in rows.select("post_id", score(masked(F.col("content"), [F.struct("decision")])).alias("m")).collect()}
    assert calls.value == 2 and {k: m["score"] for k, m in found.items()} == {1: 3.0, 2: None, 3: 100_000.0, 4: None}
    assert found[1]["seconds"] > 0 and found[2]["seconds"] is None
