"""Aggregates over the decision table.

Every report is one grouped aggregate with map-side partial sums, so a group that holds a third of
all rows costs no more than any other.  Sections that share a grouping are computed in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsieve import constants as K
from modsieve.functions import labels as L
from modsieve.operators.quantiles import describe
from modsieve.session import materialize


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def stats_totals(posts: DataFrame) -> DataFrame:
    counted = posts.agg(F.count("*").alias("total_posts"), F.count_if("accepted").alias("accepted"))
    return counted.select(
        "total_posts", "accepted", (F.col("total_posts") - F.col("accepted")).alias("rejected"),
        # half-even on two decimals
        F.bround(percent(F.col("accepted"), F.col("total_posts")), 2).alias("acceptance_rate"),
    )


def rejection_by_stage(posts: DataFrame) -> DataFrame:
    # counting under a condition instead of filtering keeps the decision expression in one place
    return posts.groupBy("stage").agg(F.count_if(~F.col("accepted")).alias("posts")).filter("posts > 0")


def counts_by(posts: DataFrame, column: str) -> DataFrame:
    return posts.groupBy(column).agg(F.count("*").alias("posts"))


def distribution(posts: DataFrame, column: str) -> DataFrame:
    """Counts and percent of all rows.  The window runs over one row per value, not over posts."""
    counts = counts_by(posts, column)
    return counts.withColumn("percent", F.col("posts") * 100.0 / F.sum("posts").over(Window.partitionBy()))


def _measures(error: str, time: str) -> list[Column]:
    t = F.col(time)
    return [
        F.count("*").alias("total_posts"),
        F.count_if(F.col(error).isNull()).alias("successful"),
        F.avg(t).alias("avg"), F.min(t).alias("min"), F.max(t).alias("max"),
        F.stddev_samp(t).alias("std"), F.count(t).alias("timed"), F.sum(t).alias("sum"),
        F.count_if("escalated").alias("escalations"),
    ]


def performance_summary(rows: DataFrame, error: str = "error", time: str = "processing_time") -> DataFrame:
    return _performance(rows.agg(*_measures(error, time)[:-1]))


def _performance(got: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return got.select(
        "total_posts", F.col("successful").alias("successful_analyses"),
        (F.col("total_posts") - F.col("successful")).alias("failed_analyses"),
        percent(F.col("successful"), F.col("total_posts")).alias("success_rate"),
        F.coalesce("avg", zero).alias("avg_processing_time"),
        F.coalesce("min", zero).alias("min_processing_time"),
        F.coalesce("max", zero).alias("max_processing_time"),
        F.when(F.col("timed") > 1, F.col("std")).otherwise(0.0).alias("std_processing_time"),
        F.coalesce("sum", zero).alias("total_processing_time"),
        F.when(F.col("sum") > 0, F.col("successful") / F.col("sum")).otherwise(0.0).alias("throughput"),
    )


def escalation_summary(rows: DataFrame, error: str = "error") -> DataFrame:
    """Total row (stage null) and one row per stage; the rate is over successful rows."""
    got = rows.rollup("stage").agg(
        F.count_if("escalated").alias("escalations"),
        F.count_if(F.col(error).isNull()).alias("successful"),
        F.grouping("stage").alias("is_total"),
    ).filter("is_total = 1 or escalations > 0")
    return got.select(
        F.when(F.col("is_total") == 1, "(all)").otherwise(F.col("stage")).alias("stage"), "escalations",
        F.when(F.col("is_total") == 1, percent(F.col("escalations"), F.col("successful"))).alias("escalation_rate"),
    )


def confidence_describe(rows: DataFrame, column: str = "confidence") -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max."""
    got = describe(rows, column, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return got.select("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def confidence_heatmap(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Mean confidence, one column per listed value, 0 where nothing was seen."""
    wide = rows.groupBy(row).pivot(column, values).agg(F.avg("confidence"))
    return wide.na.fill(0.0, values)


def mean_time_by(rows: DataFrame, column: str, time: str = "processing_time") -> DataFrame:
    return rows.groupBy(column).agg(F.avg(time).alias("avg_time"))


def escalations_by_model(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy("decision_model").agg(F.count_if("escalated").alias("posts")).filter("posts > 0")
    )


def histogram(rows: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, the last one closed.

    When all values are equal the bins span half a unit to each side.
    """
    values = rows.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    ends = values.select(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    flat = F.col("ends")["hi"] == F.col("ends")["lo"]
    lo = F.when(flat, F.col("ends")["lo"] - 0.5).otherwise(F.col("ends")["lo"])
    span = F.when(flat, F.lit(1.0)).otherwise(F.col("ends")["hi"] - F.col("ends")["lo"])
    place = F.least(F.floor((F.col("x") - lo) / (span / bins)), F.lit(bins - 1)).cast("int")
    return values.withColumn("ends", ends).select(place.alias("bin")).groupBy("bin").agg(F.count("*").alias("posts"))


def latency_by_category(rows: DataFrame) -> DataFrame:
    t = F.col("processing_time")
    return rows.groupBy("category").agg(
        F.count(t).alias("count"), F.avg(t).alias("avg_latency"), F.min(t).alias("min_latency"),
        F.max(t).alias("max_latency"), F.coalesce(F.stddev_samp(t), F.lit(0.0)).alias("std_dev"),
    )


def latency_overall(rows: DataFrame) -> DataFrame:
    t, zero = F.col("processing_time"), F.lit(0.0)
    return rows.agg(
        F.coalesce(F.avg(t), zero).alias("avg_latency"), F.coalesce(F.min(t), zero).alias("min_latency"),
        F.coalesce(F.max(t), zero).alias("max_latency"), F.count(t).alias("total_requests"),
    )


def escalations_by_category(rows: DataFrame, error: str = "error") -> DataFrame:
    """Total and parts from one rollup."""
    got = rows.rollup("category").agg(
        F.count_if("escalated").alias("escalations"),
        F.count_if(F.col(error).isNull()).alias("successful"),
        F.grouping("category").alias("is_total"),
    ).filter("is_total = 1 or escalations > 0")
    return got.select(
        F.when(F.col("is_total") == 1, "(all)").otherwise(F.col("category")).alias("category"), "escalations",
        F.when(F.col("is_total") == 1, percent(F.col("escalations"), F.col("successful"))).alias("escalation_rate"),
    )


def accuracy_by_category(rows: DataFrame, error: str = "error") -> DataFrame:
    """Correct means accepted is the opposite of expected to be rejected; failed rows do not count."""
    correct = F.col("accepted") != L.expect_rejected(F.col("category"))
    ok = F.col(error).isNull()
    got = rows.groupBy("category").agg(
        F.count_if(ok).alias("total_tests"), F.count_if(ok & correct).alias("correct_decisions")
    ).filter("total_tests > 0")
    return got.select("category", (F.col("correct_decisions") * 100.0 / F.col("total_tests")).alias("accuracy"),
                      "total_tests", "correct_decisions")


def accuracy_expected_output(rows: DataFrame, expected: str = "expected_output", actual: str = "action") -> DataFrame:
    match = L.expectation_match(F.col(expected), F.col(actual))
    got = rows.agg(F.count(expected).alias("total_with_expected_output"), F.count_if(match).alias("correct"))
    n = F.col("total_with_expected_output")
    return got.select("total_with_expected_output", (n > 0).alias("accuracy_available"), "correct",
                      F.when(n > 0, F.col("correct") * 100.0 / n).alias("accuracy"))


def false_pos_neg(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if((F.col("category") == "clean") & ~F.col("accepted")).alias("false_positives"),
        F.count_if(L.expect_rejected(F.col("category")) & F.col("accepted")).alias("false_negatives"),
    )


def confidence_by_category_and_stage(rows: DataFrame) -> DataFrame:
    """Both means from one pass over grouping sets."""
    got = rows.groupingSets([["category"], ["stage"]], "category", "stage").agg(
        F.avg("confidence").alias("avg_confidence"), F.grouping("category").alias("no_category"))
    return got.select(
        F.when(F.col("no_category") == 1, "stage").otherwise("category").alias("grouped_by"),
        F.coalesce("category", "stage").alias("value"), "avg_confidence")


def posts_by_stage_outcome(trace: DataFrame) -> DataFrame:
    """From the stage trace: how many posts each stage blocked, escalated or passed."""
    return trace.groupBy("stage", "decision").agg(F.count("*").alias("posts"))


def avg_time_by_stage(posts: DataFrame) -> DataFrame:
    """Mean of the five stage timings over the posts that reached the stage.

    Wide conditional means in one row, unpivoted afterwards: five times fewer rows than unpivoting first.
    """
    reached = [
        F.avg(F.when(F.col("n_executed") >= number, F.col(column))).alias(stage)
        for number, (stage, column) in enumerate(K.STAGE_TIME_COLUMN.items(), start=1)
    ]
    return posts.agg(*reached).unpivot([], K.STAGE_ORDER, "stage", "avg_time")


def posts_per_hour(posts: DataFrame) -> DataFrame:
    return posts.groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(F.count("*").alias("posts"))


def top_bands(rows: DataFrame, n: int = 3) -> DataFrame:
    counts = counts_by(rows, "band")
    return counts.orderBy(F.desc("posts"), "band").limit(n)


def report_cells(rows: DataFrame, columns: list[str], measures: list[Column]) -> DataFrame:
    """The measures of all rows and of every value of each column, from one pass; ``no_<column>`` is 0 where the cell is of a value of the column."""
    flags = [F.grouping(c).alias(f"no_{c}") for c in columns]
    return materialize(rows.groupingSets([[], *[[c] for c in columns]], *columns).agg(*measures, *flags), "report_cells")


def _total(cells: DataFrame, columns: list[str], counts: list[str], others: list[str]) -> DataFrame:
    """The cell of all rows; of no rows at all, one with counts of 0."""
    whole = cells.filter(" and ".join(f"no_{c} = 1" for c in columns))
    return whole.agg(*[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in counts], *[F.max(c).alias(c) for c in others])


def analysis_report(rows: DataFrame) -> DataFrame:
    """One row with every section as a struct or map.

    All sections but the quantiles of the confidence are cut from the cells of one pass over ``rows``.
    """
    columns = ["stage", "band", "decision_model"]
    cells = report_cells(rows, columns, _measures("error", "processing_time"))
    total = _total(cells, columns, ["total_posts", "successful", "timed", "escalations"], ["avg", "min", "max", "std", "sum"])

    def as_map(column: str, measure: str, condition: str = "true") -> Column:
        own = cells.filter(f"no_{column} = 0 and {condition}")
        return own.select(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, F.col(measure).alias("posts")))))).scalar()

    escalated = total.select(F.struct("escalations", percent(F.col("escalations"), F.col("successful")).alias("escalation_rate"))).scalar()
    return _performance(total).select(
        F.struct("*").alias("performance"),
        escalated.alias("escalation"),
        as_map("stage", "escalations", "escalations > 0 and stage is not null").alias("escalations_by_stage"),
        as_map("band", "total_posts").alias("band_distribution"),
        as_map("decision_model", "total_posts").alias("model_decisions"),
        as_map("stage", "total_posts").alias("stage_distribution"),
        confidence_describe(rows).select(F.struct("*")).scalar().alias("confidence_stats"),
    )


def report_rows(report: DataFrame) -> DataFrame:
    """A one-row report as ``section, key, metric, value``: what the JSON document holds, one number a row."""
    def entry(section: str, key: Column, metric: str, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), key.alias("key"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))

    def entries_of(name: str, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.array(*[entry(name, F.lit(""), n, F.col(name)[n]) for n in kind.names])
        pairs = F.map_entries(name)
        if isinstance(kind.valueType, T.StructType):
            return F.flatten(F.transform(pairs, lambda e: F.array(*[entry(name, e["key"], n, e["value"][n]) for n in kind.valueType.names])))
        return F.transform(pairs, lambda e: entry(name, e["key"], "posts", e["value"]))

    entries = [entries_of(field.name, field.dataType) for field in report.schema]
    return report.select(F.explode(F.concat(*entries)).alias("e")).select("e.*").filter("value is not null")


def benchmark_report(rows: DataFrame) -> DataFrame:
    """The labelled-run report: summary, latency, escalation and accuracy in one row, cut from the cells of one pass over ``rows``."""
    ok, t = F.col("error").isNull(), F.col("processing_time")
    good = F.when(ok, t)
    correct = F.col("accepted") != L.expect_rejected(F.col("category"))
    cells = report_cells(rows, ["category"], [
        F.count("*").alias("total_tests"), F.count_if(ok).alias("successful"), F.count_if(ok & correct).alias("correct"), F.count_if("escalated").alias("escalations"),
        F.avg(t).alias("avg"), F.min(t).alias("min"), F.max(t).alias("max"), F.count(t).alias("timed"),
        F.count(good).alias("good_count"), F.avg(good).alias("good_avg"), F.min(good).alias("good_min"), F.max(good).alias("good_max"), F.stddev_samp(good).alias("good_std")])
    total = _total(cells, ["category"], ["total_tests", "successful", "timed", "escalations"], ["avg", "min", "max"])

    def as_map(section: DataFrame, key: Column, *fields: Column) -> Column:
        return section.select(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("category"), F.struct(*fields)))))).scalar()

    own, zero = cells.filter("no_category = 0"), F.lit(0.0)
    whole = F.col("no_category") == 1
    return total.select(
        F.struct(
            "total_tests", F.col("successful").alias("successful_tests"), (F.col("total_tests") - F.col("successful")).alias("failed_tests"),
            percent(F.col("successful"), F.col("total_tests")).alias("success_rate"),
        ).alias("summary"),
        F.struct(
            F.coalesce("avg", zero).alias("avg_latency"), F.coalesce("min", zero).alias("min_latency"), F.coalesce("max", zero).alias("max_latency"),
            F.col("timed").alias("total_requests"),
        ).alias("overall_latency"),
        as_map(own.filter("successful > 0"), F.col("category"), F.col("good_count").alias("count"), F.col("good_avg").alias("avg_latency"), F.col("good_min").alias("min_latency"),
               F.col("good_max").alias("max_latency"), F.coalesce("good_std", zero).alias("std_dev")).alias("latency_by_category"),
        as_map(cells.filter("no_category = 1 or escalations > 0"), F.when(whole, "(all)").otherwise(F.col("category")), F.col("escalations"),
               F.when(whole, percent(F.col("escalations"), F.col("successful"))).alias("escalation_rate")).alias("escalation"),
        as_map(own.filter("successful > 0"), F.col("category"), (F.col("correct") * 100.0 / F.col("successful")).alias("accuracy"), F.col("successful").alias("total_tests"),
               F.col("correct").alias("correct_decisions")).alias("accuracy"),
    )
