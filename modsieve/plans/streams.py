"""Queries: the stream jobs, run to the end of the supplied files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from modsieve.functions.text import iso_time
from modsieve.operators import cascade as C
from modsieve.plans import fixtures as X
from modsieve.plans.registry import query
from modsieve.plans.rules_and_stages import DECISION_SQL
from modsieve.plans.sqlviews import norm, ts_text, using
from modsieve.session import materialize, read_table, scratch_path, table_path
from modsieve.streaming import jobs as J


def stream_of(spark, sf, name: str):
    # a table is one file or a folder of files: a pattern of one name takes both, a plain path only the folder
    return J.read_stream(spark, table_path(sf, f"{{{name}}}"), "*", read_table(spark, sf, name).schema)


def decided_once(spark, sf):
    """Decisions of all documents, written once: every micro-batch joins this table."""
    return materialize(X.decisions(spark, sf), "decisions")


#: Events arrive in so many triggers of so many files each, in the order of time but for every seventh: that comes a trigger late.
TRIGGERS, FILES, DAYS = 4, 2, 8
#: More than the days of a trigger: a row that comes one trigger late is in time.
LATE = "10 days"


def events_in_files(spark, sf):
    """The events as a stream: files written one trigger after the other, some rows in the files of the next."""
    folder = scratch_path(spark, "events")
    events = X.events(spark, sf)
    own = F.floor((F.dayofmonth("ts") - 1) / DAYS) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    for k in range(TRIGGERS):
        events.filter(F.least(own, F.lit(TRIGGERS - 1)) == k).repartition(FILES).write.mode("append").parquet(folder)
    return J.read_stream(spark, folder, "*.parquet", events.schema, files_per_trigger=FILES)


def log_of(events, spark, sf):
    return X.log_from(events, decided_once(spark, sf), F.lit(read_table(spark, sf, "documents").count()))


def log_stream(spark, sf):
    return log_of(events_in_files(spark, sf), spark, sf)


def finish(stream_query):
    stream_query.awaitTermination()
    if stream_query.exception() is not None:
        raise stream_query.exception()


@query("stream_moderate", using("decided", body=DECISION_SQL))
def _(spark, sf):
    out = scratch_path(spark, "stream-moderate")
    posts = X.plant(stream_of(spark, sf, "documents").select("doc_id", "text"))
    decided = J.stream_moderate(posts, lambda p: C.decision_columns(
        X.decide(p, X.toxicity_scores(spark, sf)), "post_id", "n_executed"))
    finish(J.append_sink(decided, f"{out}/rows", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/rows").withColumn("confidence", F.round("confidence", 6))


@query("stream_posts_per_hour", using("posts_log", body=f"""
select {ts_text("date_trunc('hour', created_at)::timestamp")} as hour, count(*) as posts from posts_log group by 1"""))
def _(spark, sf):
    # all rows are the stream's own: hours are emitted as they change, and corrected when late posts come
    out = scratch_path(spark, "stream-hours")
    finish(J.batch_sink(J.stream_posts_per_hour(log_stream(spark, sf), late=LATE), J.versioned_writer(f"{out}/log"), "update", f"{out}/checkpoint"))
    return J.latest_per_key(spark, f"{out}/log", ["hour"]).select(iso_time(F.col("hour")).alias("hour"), "posts")


@query("stream_stage_stats", using("posts_log", body=f"""
select {ts_text("date_trunc('day', created_at)::timestamp")} as window_start, stage, band, count(*) as posts,
  round(avg(processing_time), 6) as avg_time from posts_log group by 1, 2, 3"""))
def _(spark, sf):
    out = scratch_path(spark, "stream-stats")
    finish(J.batch_sink(J.stream_stage_stats(log_stream(spark, sf), late=LATE), J.versioned_writer(f"{out}/log"), "update", f"{out}/checkpoint"))
    state = J.latest_per_key(spark, f"{out}/log", ["window_start", "stage", "band"])
    return state.select(iso_time(F.col("window_start")).alias("window_start"), "stage", "band", "posts",
                        F.round("avg_time", 6).alias("avg_time"))


@query("stream_overrides", using("overrides", body="""
select post_id, arg_max(override_value, seq) as override_value from overrides
where override_value in ('Accepted', 'Rejected', 'Flagged')
  and ts = (select max(o.ts) from overrides o where o.post_id = overrides.post_id and o.override_value in ('Accepted', 'Rejected', 'Flagged'))
group by post_id"""))
def _(spark, sf):
    out = scratch_path(spark, "stream-overrides")
    posts = read_table(spark, sf, "documents").count()
    commands = X.override_commands(events_in_files(spark, sf), F.lit(posts + 50))
    valid = commands.filter(F.col("override_value").isin("Accepted", "Rejected", "Flagged"))
    finish(J.batch_sink(valid, J.override_writer(f"{out}/log"), "append", f"{out}/checkpoint"))
    return J.current_overrides(spark, f"{out}/log").select("post_id", "override_value")


@query("stream_dedup", f"""
with posts as (select doc_id as post_id, sha256({norm('text')}) as copy, least(doc_id % 4, 3) as batch, doc_id * 100 as day from documents),
ranked as (select *, row_number() over (partition by copy order by batch, day, post_id) as place from posts)
select copy, post_id from ranked where place = 1""")
def _(spark, sf):
    # four batches; copies come up to years apart
    out, folder = scratch_path(spark, "stream-dedup"), scratch_path(spark, "posts")
    posts = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("post_id"), F.col("text").alias("content"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 100 * 86400).alias("created_at"))
    for k in range(TRIGGERS):
        posts.filter(F.col("post_id") % TRIGGERS == k).repartition(FILES).write.mode("append").parquet(folder)
    table = J.CopyTable(spark, f"{out}/copies")
    finish(J.batch_sink(J.read_stream(spark, folder, "*.parquet", posts.schema, files_per_trigger=FILES), table.write, "append", f"{out}/checkpoint"))
    found = materialize(table.rows().select("copy", "post_id"), "survivors")
    table.close()
    return found


@query("stream_running_totals", using("posts_log", body="""
select stage, threat_level, count(*) as posts, count(*) filter (accepted) as accepted from posts_log group by 1, 2"""))
def _(spark, sf):
    out = scratch_path(spark, "stream-totals")
    finish(J.batch_sink(J.stream_running_totals(log_stream(spark, sf)), J.versioned_writer(f"{out}/log"), "complete", f"{out}/checkpoint"))
    return J.latest_per_key(spark, f"{out}/log", ["stage", "threat_level"])
