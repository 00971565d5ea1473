"""Queries: overrides, comments, joins, lookups, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from modsieve.functions.text import iso_time
from modsieve.operators import review as V
from modsieve.operators.providers import score_join
from modsieve.plans import fixtures as X
from modsieve.plans.registry import query
from modsieve.plans.sqlviews import ts_text, using
from modsieve.session import materialize, read_table, scratch_path

LATEST = """
select post_id, override_value, ts, seq from (
  select *, row_number() over (partition by post_id order by ts desc, seq desc) as rn from overrides
  where override_value in ('Accepted', 'Rejected', 'Flagged')) where rn = 1"""


def narrow_posts(spark, sf):
    """Posts rows without the wide text: joins by post id must not move it."""
    return X.posts_table(spark, sf, keep_content=False)


@query("latest_command", using("overrides", body=f"""
select post_id, override_value, seq from ({LATEST})"""))
def _(spark, sf):
    return V.latest_command(V.valid_overrides(X.overrides(spark, sf)), "override_value").select("post_id", "override_value", "seq")


@query("override_apply", using("posts", "overrides", extra={"latest": LATEST}, body="""
select post_id, case when changed then 'Yes' else 'No' end as override,
  case when changed then override_value = 'Accepted' else accepted end as accepted,
  case when not changed then action when override_value = 'Accepted' then 'PASS' when override_value = 'Rejected' then 'BLOCK'
       else 'FLAG_MEDIUM' end as action, reason, stage
from (select p.*, l.override_value, coalesce(l.override_value <> case when accepted then 'Accepted' when lower(action) like '%flag%' then 'Flagged'
        else 'Rejected' end, false) as changed from posts p left join latest l using (post_id))"""))
def _(spark, sf):
    applied = V.override_apply(narrow_posts(spark, sf), X.overrides(spark, sf))
    return applied.select("post_id", "override", "accepted", "action", "reason", "stage")


FIRST = """
select post_id, override_value from (
  select *, row_number() over (partition by post_id order by ts desc, seq desc) as rn from overrides where override_value in ('Rejected', 'Flagged')) where rn = 1"""


@query("override_again", using("posts", "overrides", extra={"latest": LATEST, "first": FIRST}, body="""
select post_id, case when told is null then 'No' when told <> original then 'Yes' else 'No' end as override,
  case when told is null or told = original then accepted else told = 'Accepted' end as accepted,
  case when told is null or told = original then action when told = 'Accepted' then 'PASS' when told = 'Rejected' then 'BLOCK'
       else 'FLAG_MEDIUM' end as action
from (select p.*, coalesce(l.override_value, f.override_value) as told, case when accepted then 'Accepted' when lower(action) like '%flag%'
        then 'Flagged' else 'Rejected' end as original
      from posts p left join latest l using (post_id) left join first f using (post_id))"""))
def _(spark, sf):
    # rows that were overridden before: what counts is the engine's decision, not what the first override left
    commands = X.overrides(spark, sf)
    once = V.override_apply(narrow_posts(spark, sf), commands.filter("override_value in ('Rejected', 'Flagged')"))
    return V.override_apply(once, commands).select("post_id", "override", "accepted", "action")


@query("override_rejects", using("overrides", body="select post_id, seq, override_value from overrides where override_value = 'Maybe'"))
def _(spark, sf):
    return V.override_rejects(X.overrides(spark, sf)).select("post_id", "seq", "override_value")


@query("override_not_found", using("overrides", body="""
select post_id, seq from overrides where post_id not in (select doc_id from documents)"""))
def _(spark, sf):
    posts = read_table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"))
    return V.not_found(X.overrides(spark, sf), posts).select("post_id", "seq")


@query("comments_apply", using("posts", "comments_cmd", extra={"latest": """
select post_id, comments from (select *, row_number() over (partition by post_id order by ts desc, seq desc) as rn
  from comments_cmd where length(comments) <= 500) where rn = 1"""}, body="""
select p.post_id, l.comments, p.action from posts p left join latest l using (post_id)"""))
def _(spark, sf):
    applied = V.comments_apply(narrow_posts(spark, sf), X.comments(spark, sf))
    return applied.select("post_id", "comments", "action")


@query("comment_rejects", using("comments_cmd", body="select post_id, seq, length(comments) as chars from comments_cmd where length(comments) > 500"))
def _(spark, sf):
    return V.comment_rejects(X.comments(spark, sf)).select("post_id", "seq", F.length("comments").alias("chars"))


@query("score_join", using("tox", body="""
select d.doc_id as post_id, tox_label as label, tox_score as score, tox_error as error, tox_score is not null as scored
from documents d left join tox on tox.post_id = d.doc_id"""))
def _(spark, sf):
    posts = read_table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"))
    return score_join(posts, X.toxicity_scores(spark, sf))


@query("gold_join", using("gold_rows", body="""
select post_id, category, expected_output, accepted, accepted <> (category in ('spam', 'fraud', 'profane')) as correct from gold_rows"""))
def _(spark, sf):
    rows = X.gold_rows(spark, sf)
    from modsieve.functions.labels import expect_rejected

    return rows.select("post_id", "category", "expected_output", "accepted",
                       (F.col("accepted") != expect_rejected(F.col("category"))).alias("correct"))


@query("reviewed_only", using("decided", "overrides", body="""
select post_id, action from decided where post_id in (select post_id from overrides)"""))
def _(spark, sf):
    return V.reviewed_only(X.decisions(spark, sf), X.overrides(spark, sf)).select("post_id", "action")


@query("unreviewed", using("decided", extra={"flagged": """
select event_id % ((select count(*) from documents) + 50) as post_id from events where event_type = 'click'"""}, body="""
select post_id, action from decided where post_id not in (select post_id from flagged)"""))
def _(spark, sf):
    rejected = X.overrides(spark, sf).filter("override_value = 'Rejected'")
    return V.unreviewed(X.decisions(spark, sf), rejected).select("post_id", "action")


@query("posts_listing", using("posts", body=f"""
select post_id as id, content, accepted, reason, threat_level, round(confidence, 6) as confidence, stage, band, action,
  round(processing_time, 6) as processing_time, override, llm_explanation,
  array_to_string(llm_troublesome_words, '|') as llm_troublesome_words, llm_suggestion, {ts_text('created_at')} as created_at
from posts order by posts.created_at desc, id desc"""))
def _(spark, sf):
    listing = V.posts_listing(X.posts_table(spark, sf))
    return listing.select(
        "id", "content", "accepted", "reason", "threat_level", F.round("confidence", 6).alias("confidence"), "stage", "band",
        "action", F.round("processing_time", 6).alias("processing_time"), "override", "llm_explanation",
        F.array_join("llm_troublesome_words", "|").alias("llm_troublesome_words"), "llm_suggestion",
        iso_time(F.col("created_at")).alias("created_at"))


@query("newest_first", using("posts_log", body=f"""
select post_id, {ts_text('created_at')} as created_at, action from posts_log order by posts_log.created_at desc, post_id desc"""))
def _(spark, sf):
    rows = X.posts_log(spark, sf).orderBy(F.desc("created_at"), F.desc("post_id"))
    return rows.select("post_id", iso_time(F.col("created_at")).alias("created_at"), "action")


@query("post_lookup", using("decided", body="""
select post_id, action, reason from decided where post_id = (select count(*) from documents) // 2"""))
def _(spark, sf):
    # stored in the order of ids, as a lookup wants it: the equality prunes all other row groups
    path = scratch_path(spark, "posts-by-id")
    # written first: finding the bounds of the ranges reads the rows once more
    rows = materialize(X.decisions(spark, sf).select("post_id", "action", "reason"), "decisions")
    rows.repartitionByRange("post_id").sortWithinPartitions("post_id").write.parquet(path)
    return V.post_by_id(spark.read.parquet(path), read_table(spark, sf, "documents").count() // 2)


@query("post_by_id", using("decided", body="""
select e.event_id as request_id, d.post_id, d.action, d.reason from events e join decided d
  on d.post_id = e.event_id % ((select count(*) from documents) + 50)"""))
def _(spark, sf):
    asked = X.events(spark, sf).select(F.col("event_id").alias("request_id"), X.command_target(spark, sf).alias("post_id"))
    return V.posts_by_request(X.decisions(spark, sf).select("post_id", "action", "reason"), asked)
