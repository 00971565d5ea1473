import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modsieve.functions import labels as L
from modsieve.operators import reports as R
from modsieve.operators.quantiles import exact_quantiles
from modsieve.operators.ranking import ranked

# One recorded run over 21 posts: confidence, seconds, threat, stage
RECORDED = [
    (0.957021526197014, 0.03911781311035156, "high", "Stage2_LGBM"), (0.8, 0.0, "medium", "Stage1_RuleBased"),
    (0.9550004932336509, 0.04900097846984863, "high", "Stage2_LGBM"), (0.9967169662400893, 0.04992246627807617, "high", "Stage2_LGBM"),
    (0.6114684382023611, 0.05351591110229492, "high", "Stage2_LGBM"), (0.9906500376043397, 0.05141162872314453, "high", "Stage2_LGBM"),
    (0.7228195084691944, 0.05216622352600098, "high", "Stage2_LGBM"), (0.6, 1.265812873840332, "low", "Stage5_LLM"),
    (0.9208067874205899, 0.03940725326538086, "high", "Stage2_LGBM"), (0.8255064080401225, 0.051355838775634766, "high", "Stage2_LGBM"),
    (0.7, 0.29181933403015137, "medium", "Stage5_LLM"), (0.5570606013723954, 0.04517650604248047, "high", "Stage2_LGBM"),
    (0.8332476749271653, 0.05238986015319824, "high", "Stage2_LGBM"), (0.6, 0.28899359703063965, "low", "Stage5_LLM"),
    (0.9568419974614305, 0.03880023956298828, "high", "Stage2_LGBM"), (0.7, 0.26137757301330566, "medium", "Stage5_LLM"),
    (0.4969752995197027, 0.045197248458862305, "high", "Stage2_LGBM"), (0.7, 0.27284860610961914, "medium", "Stage5_LLM"),
    (0.6, 0.2800173759460449, "low", "Stage5_LLM"), (0.6, 0.26023340225219727, "low", "Stage5_LLM"),
    (0.6, 0.30859827995300293, "low", "Stage5_LLM"),
]


@pytest.fixture(scope="module")
def recorded(spark):
    df = spark.createDataFrame(RECORDED, "confidence double, processing_time double, threat_level string, stage string")
    return df.withColumns({"error": F.lit(None).cast("string"), "band": L.band_of(F.col("threat_level")),
                           "decision_model": L.model_of(F.col("stage"))})


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9)


def test_recorded_performance(recorded):
    r = R.performance_summary(recorded).first()
    assert (r.total_posts, r.successful_analyses, r.failed_analyses, r.success_rate, r.min_processing_time) == (21, 21, 0, 100.0, 0.0)
    assert close(r.avg_processing_time, 0.1808172861735026) and close(r.max_processing_time, 1.265812873840332)
    assert close(r.std_processing_time, 0.27346573707364014) and close(r.throughput, 5.5304446890130485)


def test_recorded_distributions(recorded):
    assert {r.band: r.posts for r in R.counts_by(recorded, "band").collect()} == {"DANGER": 12, "SAFE": 5, "WARNING": 4}
    assert {r.stage: r.posts for r in R.counts_by(recorded, "stage").collect()} == {
        "Stage2_LGBM": 12, "Stage5_LLM": 8, "Stage1_RuleBased": 1}
    assert [r.band for r in R.top_bands(recorded).collect()] == ["DANGER", "SAFE", "WARNING"]
    assert abs(sum(r.percent for r in R.distribution(recorded, "band").collect()) - 100) < 1e-9


def test_recorded_confidence(recorded):
    r = R.confidence_describe(recorded).first()
    want = (21, 0.7487674161280025, 0.16307969814636422, 0.4969752995197027, 0.6, 0.7, 0.9208067874205899, 0.9967169662400893)
    assert all(close(a, b) for a, b in zip(r, want))


def test_single_row_and_empty_table(spark, recorded):
    one = recorded.limit(1)
    assert R.performance_summary(one).first().std_processing_time == 0.0
    none = recorded.filter("false")
    r = R.performance_summary(none).first()
    assert (r.total_posts, r.success_rate, r.avg_processing_time, r.throughput) == (0, 0.0, 0.0, 0.0)
    empty = spark.createDataFrame([], "accepted boolean")
    assert tuple(R.stats_totals(empty).first()) == (0, 0, 0, 0.0)
    assert R.confidence_describe(none).first()["count"] == 0


def test_rate_rounds_half_even(spark):
    df = spark.range(800).select((F.col("id") < 97).alias("accepted"))  # 12.125 percent
    assert R.stats_totals(df).first().acceptance_rate == 12.12


def test_escalation_rule(spark):
    rows = [("low", 0.7, "PASS", False), ("low", 0.69, "PASS", True), ("medium", 0.9, "PASS", True), ("low", 0.9, "FLAG_LOW", True)]
    df = spark.createDataFrame(rows, "t string, c double, a string, want boolean")
    assert df.filter(L.is_escalated(F.col("t"), F.col("c"), F.lit("x"), F.col("a")) != F.col("want")).count() == 0


def test_histograms_like_numpy(spark):
    rng = np.random.default_rng(3)
    for values in (rng.integers(0, 2000, 500) / 64.0, np.full(7, 0.25), np.arange(21.0)):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        got = {r.bin: r.posts for r in R.histogram(df, "x").collect()}
        want = {i: int(n) for i, n in enumerate(np.histogram(values, 20)[0]) if n}
        assert got == want


@pytest.mark.parametrize("kind", ["hot", "outlier", "wide", "two"])
def test_exact_quantiles_like_numpy(spark, kind):
    rng = np.random.default_rng(5)
    values = {
        "hot": np.concatenate([np.full(20_000, 0.5), rng.random(20_001)]),
        "outlier": np.concatenate([rng.random(30_000), [1e12, -1e12]]),
        "wide": rng.normal(0, 1, 50_000),
        "two": np.array([1.0, 2.0]),
    }[kind]
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = exact_quantiles(df, "x", probs, accuracy=500).first()
    assert np.allclose(list(got), np.quantile(values, list(probs.values())), rtol=1e-12, atol=0)


def test_row_numbers_with_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 50}", (i * 48271) % 10007) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, g string, o long")
    got = {r.id: r.row_number for r in ranked(df, "o", ["g"], "id").collect()}
    place, want = {}, {}
    for i, g, o in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        place[g] = want[i] = place.get(g, 0) + 1
    assert got == want
    everything = {r.id: r.n for r in ranked(df, "o", tie="id", name="n").collect()}
    assert [i for i, _ in sorted(everything.items(), key=lambda p: p[1])] == [i for i, _, o in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert sorted(everything.values()) == list(range(1, 6001))


def test_row_numbers_with_outliers_nulls_and_repeats(spark):
    values = [None, None, -1e300, 5.0, 5.0, 5.0, *[k / 1e6 for k in range(3_000)], 1e300]
    rows = [(k, v, None if k % 3 else "g") for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, v double, g string")
    got = ranked(df, "v", tie="id").collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert [r.id for r in sorted(got, key=lambda r: r.row_number)] == [r[0] for r in want]
    assert [r.row_number for r in sorted(got, key=lambda r: r.row_number)] == list(range(1, len(values) + 1))
    grouped = ranked(df, "v", ["g"]).collect()
    for name in (None, "g"):
        numbers = sorted(r.row_number for r in grouped if r.g == name)
        assert numbers == list(range(1, sum(r[2] == name for r in rows) + 1))


def test_filters_and_expansion_keep_all_rows(spark):
    from modsieve.operators.rows import expand, filter_once

    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id int, xs array<int>")
    assert sorted((r.id, r.x) for r in expand(df, "xs", "x", "id").collect()) == [(1, 1), (1, 2)]
    assert [r.id for r in filter_once(df, F.col("id") > 1).orderBy("id").collect()] == [2, 3]


def test_reports_read_the_rows_once(spark, tmp_path):
    rows = spark.range(60).selectExpr(
        "case when id % 7 = 0 then 'boom' end as error", "id / 10.0D as processing_time", "id % 3 = 0 as escalated", "concat('s', id % 4) as stage",
        "concat('b', id % 2) as band", "concat('m', id % 5) as decision_model", "id / 60.0D as confidence", "concat('c', id % 3) as category", "id % 2 = 0 as accepted")
    path = str(tmp_path / "decided_rows")
    rows.write.parquet(path)
    read = spark.read.parquet(path)

    def scans(frame):
        plan = frame._jdf.queryExecution().optimizedPlan().toString() + frame._jdf.queryExecution().executedPlan().toString()
        return plan.count("decided_rows")

    assert scans(R.benchmark_report(read)) == 0
    # only the quantiles come back to the rows
    assert scans(R.analysis_report(read)) == scans(R.confidence_describe(read))
    for empty in (R.analysis_report(read.limit(0)), R.benchmark_report(read.limit(0))):
        assert empty.count() == 1
