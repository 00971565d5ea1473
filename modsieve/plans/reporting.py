"""Queries: statistics and reports over the decision table."""

from __future__ import annotations

from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.operators import cascade as C
from modsieve.operators import reports as R
from modsieve.plans import fixtures as X
from modsieve.plans.registry import query
from modsieve.plans.sqlviews import using
from modsieve.session import materialize


def stored(spark, sf, *columns: str):
    """Analysis columns written once, for reports that read them more than once."""
    return materialize(X.analysis_rows(spark, sf).select(*columns), "analysis")


def rounded(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("stats_totals", using("posts_log", body="""
select count(*) as total_posts, count(*) filter (accepted) as accepted, count(*) filter (not accepted) as rejected,
  round_even(count(*) filter (accepted) * 100.0::double / count(*), 2) as acceptance_rate from posts_log"""))
def _(spark, sf):
    return R.stats_totals(X.posts_log(spark, sf))


@query("rejection_by_stage", using("posts_log", body="""
select stage, count(*) as posts from posts_log where not accepted group by stage"""))
def _(spark, sf):
    return R.rejection_by_stage(X.posts_log(spark, sf))


@query("rejection_by_rule", using("stage1", body="""
select r1 as reason, count(*) as posts from stage1 where d1 = 'BLOCK' group by r1"""))
def rejection_by_rule(spark, sf):
    """How many posts does the rules stage reject, by which rule?"""
    from modsieve.operators.stages import rules_stage

    stage = rules_stage()
    posts = stage.prepare(X.planted(spark, sf))
    results = posts.select(stage.decide(posts, []).alias("r"))
    counted = results.groupBy(F.col("r")["reason"].alias("reason")).agg(
        F.count_if(F.col("r")["decision"] == "BLOCK").alias("posts"))
    return counted.filter("posts > 0")


@query("threat_level_counts", using("posts_log", body="select threat_level, count(*) as posts from posts_log group by 1"))
def _(spark, sf):
    return R.counts_by(X.posts_log(spark, sf), "threat_level")


@query("performance_summary", using("analysed", body="""
select count(*) as total_posts, count(*) filter (error is null) as successful_analyses,
  count(*) filter (error is not null) as failed_analyses,
  round(count(*) filter (error is null) * 100.0::double / count(*), 6) as success_rate,
  round(avg(processing_time), 6) as avg_processing_time, round(min(processing_time), 6) as min_processing_time,
  round(max(processing_time), 6) as max_processing_time, round(stddev_samp(processing_time), 6) as std_processing_time,
  round(sum(processing_time), 6) as total_processing_time,
  round(count(*) filter (error is null) / sum(processing_time), 6) as throughput from analysed"""))
def _(spark, sf):
    out = R.performance_summary(X.analysis_rows(spark, sf))
    return rounded(out, *out.columns[3:])


@query("escalation_summary", using("analysed", body="""
select '(all)' as stage, count(*) filter (escalated) as escalations,
  round(count(*) filter (escalated) * 100.0::double / count(*) filter (error is null), 6) as escalation_rate from analysed
union all select stage, count(*), null from analysed where escalated group by stage"""))
def _(spark, sf):
    return rounded(R.escalation_summary(X.analysis_rows(spark, sf)), "escalation_rate")


def _distribution_sql(column: str) -> str:
    return using("analysed", body=f"""
select {column}, count(*) as posts, round(count(*) * 100.0::double / (select count(*) from analysed), 6) as percent
from analysed group by {column}""")


@query("band_distribution", _distribution_sql("band"))
def _(spark, sf):
    return rounded(R.distribution(X.analysis_rows(spark, sf), "band"), "percent")


@query("model_distribution", _distribution_sql("decision_model"))
def _(spark, sf):
    return rounded(R.distribution(X.analysis_rows(spark, sf), "decision_model"), "percent")


@query("stage_distribution", _distribution_sql("stage"))
def _(spark, sf):
    return rounded(R.distribution(X.analysis_rows(spark, sf), "stage"), "percent")


@query("confidence_describe", using("analysed", body="""
select count(confidence) as count, round(avg(confidence), 6) as mean, round(stddev_samp(confidence), 6) as std,
  round(min(confidence), 6) as min, round(quantile_cont(confidence, 0.25), 6) as p25,
  round(quantile_cont(confidence, 0.5), 6) as p50, round(quantile_cont(confidence, 0.75), 6) as p75,
  round(max(confidence), 6) as max from analysed"""))
def _(spark, sf):
    out = R.confidence_describe(stored(spark, sf, "confidence"))
    return rounded(out, *out.columns[1:])


@query("time_describe", using("analysed", body="""
select count(processing_time) as count, round(avg(processing_time), 6) as mean, round(stddev_samp(processing_time), 6) as std,
  round(min(processing_time), 6) as min, round(quantile_cont(processing_time, 0.25), 6) as p25,
  round(quantile_cont(processing_time, 0.5), 6) as p50, round(quantile_cont(processing_time, 0.75), 6) as p75,
  round(max(processing_time), 6) as max from analysed"""))
def _(spark, sf):
    out = R.confidence_describe(stored(spark, sf, "processing_time"), "processing_time")
    return rounded(out, *out.columns[1:])


MODELS = list(K.STAGE_DISPLAY.values()) + ["Error"]


@query("heatmap_band_model", using("analysed", body="select band, " + ", ".join(
    f"round(coalesce(avg(confidence) filter (decision_model = '{m}'), 0), 6) as \"{m}\"" for m in MODELS)
    + " from analysed group by band"))
def _(spark, sf):
    return rounded(R.confidence_heatmap(X.analysis_rows(spark, sf), "band", "decision_model", MODELS), *MODELS)


@query("heatmap_threat_category", using("gold_rows", body="select threat_level, " + ", ".join(
    f"round(coalesce(avg(confidence) filter (category = '{c}'), 0), 6) as {c}" for c in K.GOLD_CATEGORIES)
    + " from gold_rows where error is null group by threat_level"))
def _(spark, sf):
    rows = X.gold_rows(spark, sf).filter("error is null")
    return rounded(R.confidence_heatmap(rows, "threat_level", "category", K.GOLD_CATEGORIES), *K.GOLD_CATEGORIES)


@query("time_by_model", using("analysed", body="""
select decision_model, round(avg(processing_time), 6) as avg_time from analysed group by 1"""))
def _(spark, sf):
    return rounded(R.mean_time_by(X.analysis_rows(spark, sf), "decision_model"), "avg_time")


@query("escalations_by_model", using("analysed", body="""
select decision_model, count(*) as posts from analysed where escalated group by 1"""))
def _(spark, sf):
    return R.escalations_by_model(X.analysis_rows(spark, sf))


def _histogram_sql(column: str) -> str:
    return using("analysed", body=f"""
select bin, count(*) as posts from (
  select least(floor(({column} - lo) / ((hi - lo) / 20)), 19)::int as bin
  from analysed, (select min({column}) as lo, max({column}) as hi from analysed)) group by bin""")


@query("time_histogram", _histogram_sql("processing_time"))
def _(spark, sf):
    return R.histogram(stored(spark, sf, "processing_time"), "processing_time")


@query("confidence_histogram", _histogram_sql("confidence"))
def _(spark, sf):
    return R.histogram(stored(spark, sf, "confidence"), "confidence")


@query("latency_by_category", using("gold_rows", body="""
select category, count(*) as count, round(avg(processing_time), 9) as avg_latency, round(min(processing_time), 9) as min_latency,
  round(max(processing_time), 9) as max_latency, round(coalesce(stddev_samp(processing_time), 0), 9) as std_dev
from gold_rows where error is null group by category"""))
def _(spark, sf):
    out = R.latency_by_category(X.gold_rows(spark, sf).filter("error is null"))
    return rounded(out, *out.columns[2:], digits=9)


@query("latency_overall", using("gold_rows", body="""
select round(avg(processing_time), 6) as avg_latency, round(min(processing_time), 6) as min_latency,
  round(max(processing_time), 6) as max_latency, count(*) as total_requests from gold_rows"""))
def _(spark, sf):
    return rounded(R.latency_overall(X.gold_rows(spark, sf)), "avg_latency", "min_latency", "max_latency")


@query("escalations_by_category", using("gold_rows", body="""
select '(all)' as category, count(*) filter (escalated) as escalations,
  round(count(*) filter (escalated) * 100.0::double / count(*) filter (error is null), 6) as escalation_rate from gold_rows
union all select category, count(*), null from gold_rows where escalated group by category"""))
def _(spark, sf):
    return rounded(R.escalations_by_category(X.gold_rows(spark, sf)), "escalation_rate")


@query("accuracy_by_category", using("gold_rows", body="""
select category, round(count(*) filter (ok) * 100.0::double / count(*), 6) as accuracy, count(*) as total_tests,
  count(*) filter (ok) as correct_decisions
from (select category, accepted <> (category in ('spam', 'fraud', 'profane')) as ok from gold_rows where error is null) group by category"""))
def _(spark, sf):
    return rounded(R.accuracy_by_category(X.gold_rows(spark, sf)), "accuracy")


@query("accuracy_expected_output", using("gold_rows", body="""
select count(expected_output) as total_with_expected_output, count(expected_output) > 0 as accuracy_available,
  count(*) filter (expected_output = action) as correct,
  round(count(*) filter (expected_output = action) * 100.0::double / count(expected_output), 6) as accuracy from gold_rows"""))
def _(spark, sf):
    return rounded(R.accuracy_expected_output(X.gold_rows(spark, sf)), "accuracy")


@query("false_pos_neg", using("gold_rows", body="""
select count(*) filter (category = 'clean' and not accepted) as false_positives,
  count(*) filter (category in ('spam', 'fraud', 'profane') and accepted) as false_negatives from gold_rows where error is null"""))
def _(spark, sf):
    return R.false_pos_neg(X.gold_rows(spark, sf).filter("error is null"))


@query("confidence_by_category_stage", using("gold_rows", body="""
select 'category' as grouped_by, category as value, round(avg(confidence), 6) as avg_confidence from gold_rows group by category
union all select 'stage', stage, round(avg(confidence), 6) from gold_rows group by stage"""))
def _(spark, sf):
    return rounded(R.confidence_by_category_and_stage(X.gold_rows(spark, sf)), "avg_confidence")


@query("posts_by_stage_outcome", using("trace", body="select stage, decision, count(*) as posts from trace group by 1, 2"))
def _(spark, sf):
    return R.posts_by_stage_outcome(C.stage_trace(X.decided(spark, sf), "post_id"))


@query("avg_time_by_stage", using("posts_log", body=" union all ".join(
    f"select '{stage}' as stage, round(avg({column}), 6) as avg_time from posts_log where n_executed >= {i}"
    for i, (stage, column) in enumerate(K.STAGE_TIME_COLUMN.items(), start=1))))
def _(spark, sf):
    return rounded(R.avg_time_by_stage(X.posts_log(spark, sf)), "avg_time")


@query("avg_time_by_band", using("posts_log", body="""
select band, round(avg(processing_time), 6) as avg_time from posts_log group by band"""))
def _(spark, sf):
    return rounded(R.mean_time_by(X.posts_log(spark, sf), "band"), "avg_time")


@query("avg_time_overall", using("posts_log", body="select round(avg(processing_time), 6) as avg_time from posts_log"))
def _(spark, sf):
    return rounded(X.posts_log(spark, sf).agg(F.avg("processing_time").alias("avg_time")), "avg_time")


@query("posts_per_hour", using("posts_log", body="""
select date_trunc('hour', created_at)::timestamp as hour, count(*) as posts from posts_log group by 1"""))
def _(spark, sf):
    return R.posts_per_hour(X.posts_log(spark, sf))


@query("top_bands", using("analysed", body="""
select band, count(*) as posts from analysed group by band order by posts desc, band limit 3"""))
def _(spark, sf):
    return R.top_bands(X.analysis_rows(spark, sf))


def _long(section: str, wide: str, key: str = "''") -> str:
    """The columns of a SQL result, but for the key, as rows of a report."""
    own = "*" if key == "''" else f"* exclude ({key})"
    source = f"(select {key} as _key, columns({own})::double from ({wide}))"
    return f"""select '{section}' as section, _key as key, metric, round(value, 9) as value
from (unpivot {source} on columns(* exclude (_key)) into name metric value value)"""


def _counts(section: str, column: str, where: str = "true") -> str:
    return f"select '{section}', {column}, 'posts', count(*)::double from analysed where {where} group by {column}"


ANALYSIS_REPORT = " union all ".join([
    _long("performance", """select count(*) as total_posts, count(*) filter (error is null) as successful_analyses,
      count(*) filter (error is not null) as failed_analyses, count(*) filter (error is null) * 100.0::double / count(*) as success_rate,
      avg(processing_time) as avg_processing_time, min(processing_time) as min_processing_time, max(processing_time) as max_processing_time,
      stddev_samp(processing_time) as std_processing_time, sum(processing_time) as total_processing_time,
      count(*) filter (error is null) / sum(processing_time) as throughput from analysed"""),
    _long("escalation", """select count(*) filter (escalated) as escalations,
      count(*) filter (escalated) * 100.0::double / count(*) filter (error is null) as escalation_rate from analysed"""),
    _counts("escalations_by_stage", "stage", "escalated"), _counts("band_distribution", "band"),
    _counts("model_decisions", "decision_model"), _counts("stage_distribution", "stage"),
    _long("confidence_stats", """select count(confidence) as count, avg(confidence) as mean, stddev_samp(confidence) as std, min(confidence) as min,
      quantile_cont(confidence, 0.25) as p25, quantile_cont(confidence, 0.5) as p50, quantile_cont(confidence, 0.75) as p75,
      max(confidence) as max from analysed"""),
])

BENCHMARK_REPORT = " union all ".join([
    _long("summary", """select count(*) as total_tests, count(*) filter (error is null) as successful_tests,
      count(*) filter (error is not null) as failed_tests, count(*) filter (error is null) * 100.0::double / count(*) as success_rate from gold_rows"""),
    _long("overall_latency", """select avg(processing_time) as avg_latency, min(processing_time) as min_latency, max(processing_time) as max_latency,
      count(*) as total_requests from gold_rows"""),
    _long("latency_by_category", """select category, count(*) as count, avg(processing_time) as avg_latency, min(processing_time) as min_latency,
      max(processing_time) as max_latency, coalesce(stddev_samp(processing_time), 0) as std_dev from gold_rows where error is null group by category""", "category"),
    _long("escalation", """select '(all)' as category, count(*) filter (escalated) as escalations,
      count(*) filter (escalated) * 100.0::double / count(*) filter (error is null) as escalation_rate from gold_rows
      union all select category, count(*), null from gold_rows where escalated group by category""", "category"),
    _long("accuracy", """select category, count(*) filter (ok) * 100.0::double / count(*) as accuracy, count(*) as total_tests,
      count(*) filter (ok) as correct_decisions from (
        select category, accepted <> (category in ('spam', 'fraud', 'profane')) as ok from gold_rows where error is null) group by category""", "category"),
])


@query("analysis_report", using("analysed", body=ANALYSIS_REPORT))
def _(spark, sf):
    return rounded(R.report_rows(R.analysis_report(materialize(X.analysis_rows(spark, sf), "analysis"))), "value", digits=9)


@query("benchmark_report", using("gold_rows", body=BENCHMARK_REPORT))
def _(spark, sf):
    return rounded(R.report_rows(R.benchmark_report(materialize(X.gold_rows(spark, sf), "benchmark"))), "value", digits=9)
