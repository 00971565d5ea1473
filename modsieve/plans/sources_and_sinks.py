"""Queries: files in, files out, contracts, logs, failed rows.  Files go to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.functions import labels as L
from modsieve.operators import cascade as C
from modsieve.operators.lexicon import lexicon_union
from modsieve.plans import fixtures as X
from modsieve.plans.registry import query
from modsieve.plans.sqlviews import ts_text, using
from modsieve.session import materialize, read_table, scratch_path, spread
from modsieve.sources import keywords as KW
from modsieve.sources import posts as P


@query("read_posts_csv", using("planted", body="select post_id::varchar as post_id, content from planted"))
def _(spark, sf):
    path = scratch_path(spark, "posts-csv")
    P.write_csv(X.planted(spark, sf), path)
    return P.read_posts_csv(spark, path)


BLANKED = """
select doc_id, case doc_id % 10 when 0 then '' when 1 then '   ' when 2 then chr(160) || chr(10) when 3 then null else text end as content
from documents"""


def blanked(spark, sf):
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    kind = F.col("doc_id") % 10
    text = (F.when(kind == 0, "").when(kind == 1, "   ").when(kind == 2, " \n")
            .when(kind == 3, F.lit(None)).otherwise(F.col("text")))
    return docs.select("doc_id", text.alias("content"))


@query("validate_columns", f"select doc_id, length(content) as chars, 'post_' || row_number() over (order by doc_id) as post_id from ({BLANKED}) where content is not null and doc_id % 10 > 2")
def _(spark, sf):
    # the id column asked for is missing: generated ids take over
    return P.load_bulk(blanked(spark, sf), "content", "no_such_column", "doc_id").select(
        "doc_id", F.length("content").alias("chars"), "post_id")


@query("skip_empty", f"select doc_id, content from ({BLANKED}) where doc_id % 10 > 3")
def _(spark, sf):
    return P.skip_empty(blanked(spark, sf))


@query("assign_post_id", """
select doc_id, doc_id::varchar as by_column, 'post_' || row_number() over (order by doc_id) as by_position from documents""")
def _(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id")
    by_column = P.assign_post_id(docs, "doc_id").withColumnRenamed("post_id", "by_column")
    return P.assign_post_id(by_column, order="doc_id").withColumnRenamed("post_id", "by_position")


@query("posts_append", using("posts_log", body="""
select post_id, action, strftime(created_at, '%Y-%m-%d') as created_date from posts_log"""))
def _(spark, sf):
    path = scratch_path(spark, "posts")
    # decided once, appended twice
    log = materialize(X.posts_log(spark, sf), "posts_log")
    P.posts_append(log.filter("accepted"), path)
    P.posts_append(log.filter("not accepted"), path)
    return spark.read.parquet(path).select("post_id", "action", F.col("created_date").cast("string").alias("created_date"))


def legacy(spark, sf):
    """The posts table as old rows have it: numbers and lists as text, some cells empty or broken."""
    posts = X.posts_table(spark, sf).withColumnRenamed("post_id", "id")
    key = F.col("id")
    texts = {c: F.col(c).cast("string") for c in ("processing_time", *K.STAGE_TIME_COLUMN.values())}
    return posts.withColumns({
        **texts,
        "confidence": F.when(key % 9 == 0, F.lit(None)).when(key % 9 == 1, "n/a").otherwise(F.col("confidence").cast("string")),
        "llm_troublesome_words": F.when(key % 9 == 2, "").otherwise(F.to_json("llm_troublesome_words")),
        "band": F.when(key % 9 != 3, F.col("band")), "override": F.when(key % 9 != 4, F.col("override")),
    })


@query("posts_legacy_load", using("posts", body="""
select post_id as id, round(case when post_id % 9 < 2 then 1.0::double else confidence end, 6) as confidence,
  round(processing_time, 6) as processing_time, round(llm_time, 6) as llm_time,
  case when post_id % 9 = 3 then 'SAFE' else band end as band, override,
  case when post_id % 9 = 2 then '' else array_to_string(llm_troublesome_words, '|') end as words from posts"""))
def _(spark, sf):
    typed = P.posts_legacy_load(legacy(spark, sf))
    return typed.select("id", F.round("confidence", 6).alias("confidence"), F.round("processing_time", 6).alias("processing_time"),
                        F.round("llm_time", 6).alias("llm_time"), "band", "override",
                        F.array_join("llm_troublesome_words", "|").alias("words"))


KEYWORD_SQL = """
select item_id as kw_idx, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') as keyword from benchmark"""


@query("lexicon_load", f"""
select kw_idx::int as kw_idx, keyword, array_to_string(regexp_extract_all(replace(keyword, ' ', ''), '.'), '.{{0,2}}') as pattern from ({KEYWORD_SQL})""")
def _(spark, sf):
    path = scratch_path(spark, "lexicon")
    KW.lexicon_save(X.benchmark_keywords(spark, sf), path)
    return KW.lexicon_load(spark, path)


@query("lexicon_save", f"select kw_idx::int as kw_idx, keyword from ({KEYWORD_SQL})")
def _(spark, sf):
    path = scratch_path(spark, "lexicon")
    KW.lexicon_save(X.benchmark_keywords(spark, sf), path)
    document = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("list"))
    return document.select(F.posexplode("list").alias("kw_idx", "keyword"))


@query("lexicon_union", f"""
select keyword, min(kw_idx) as kw_idx from (
  select kw_idx, keyword from ({KEYWORD_SQL})
  union all select item_id * 1048576 + part + (select max(kw_idx) from ({KEYWORD_SQL})), w[part] from (
    select item_id, w, unnest(range(1, len(w) + 1)) as part from (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from benchmark))
  union all select kw_idx + 1 + (select max(kw_idx) from ({KEYWORD_SQL})), keyword from ({KEYWORD_SQL})) group by keyword""")
def _(spark, sf):
    old = X.benchmark_keywords(spark, sf)
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    every = read_table(spark, sf, "benchmark").select("item_id", F.posexplode(words).alias("part", "keyword"))
    return lexicon_union(old, every.select((F.col("item_id") * (1 << 20) + F.col("part")).alias("kw_idx"), "keyword").unionByName(old))


@query("results_sink", using("analysed", body="""
select post_id, final_status, band, action, reason, escalated, accepted, error from analysed"""))
def _(spark, sf):
    path = scratch_path(spark, "results")
    P.write_results(X.analysis_rows(spark, sf), path)
    return spark.read.parquet(path).select("post_id", "final_status", "band", "action", "reason", "escalated", "accepted", "error")


@query("report_sink", using("analysed", body="select band, count(*) as posts from analysed group by band"))
def _(spark, sf):
    from modsieve.operators.reports import counts_by

    path = scratch_path(spark, "report")
    P.write_report(counts_by(X.analysis_rows(spark, sf), "band"), path)
    return spark.read.schema("band string, posts bigint").json(path)


@query("train_csv_io", using("training", body="select text, label from training"))
def _(spark, sf):
    path = scratch_path(spark, "train-csv")
    P.write_csv(X.training(spark, sf).select("text", "label"), path)
    return P.read_train_csv(spark, path)


@query("audit_log", using("posts", "comments_cmd", body=f"""
select post_id, 0 as line_no, {ts_text('created_at')} || 'Z' as "timestamp", 'INFO' as level, 'main' as module,
  'Incoming moderation request' as message, content[1:100] as content, case when post_id % 3 = 0 then 'note ' || post_id end as comments,
  null::bigint as content_id, null::varchar as decision from posts
union all select post_id, 1, {ts_text('created_at')} || 'Z', 'INFO', 'main', 'Moderation decision', null, null, post_id,
  case when accepted then 'ACCEPTED' else 'REJECTED' end from posts
union all select post_id, 2, {ts_text('ts')} || 'Z', 'INFO', 'main', 'Comments updated', null, comments, post_id, null from comments_cmd
where length(comments) <= 500"""))
def _(spark, sf):
    asked = X.posts_table(spark, sf).withColumn("comments", F.when(F.col("post_id") % 3 == 0, F.concat(F.lit("note "), F.col("post_id").cast("string"))))
    saved = X.comments(spark, sf).filter(F.length("comments") <= K.COMMENT_MAX_CHARS)
    lines = P.audit_events(asked).unionByName(P.audit_comments(saved).withColumn("line_no", F.lit(2)))
    path = scratch_path(spark, "audit")
    lines.select(F.to_json(F.struct("post_id", "line_no", "line")).alias("value")).write.text(path)
    back = spark.read.schema("post_id bigint, line_no int, line string").json(path)
    parsed = F.from_json("line", "timestamp string, level string, module string, message string, content string, "
                                 "comments string, content_id bigint, decision string")
    return back.select("post_id", "line_no", parsed.alias("l")).select("post_id", "line_no", "l.*")


@query("audit_overrides", using("decided", "overrides", body=f"""
select o.post_id, {ts_text('o.ts')} || 'Z' as "timestamp", o.override_value as overridden_decision,
  case when accepted then 'Accepted' when action = 'FLAG_MEDIUM' then 'Flagged' else 'Rejected' end as original_decision
from overrides o join decided d using (post_id)"""))
def _(spark, sf):
    before = X.decisions(spark, sf).select("post_id", L.review_label(F.col("accepted"), F.col("action")).alias("original_label"))
    lines = P.audit_commands(X.overrides(spark, sf).join(before, "post_id"))
    parsed = F.from_json("line", "timestamp string, original_decision string, overridden_decision string")
    return lines.select("post_id", parsed.alias("l")).select("post_id", "l.*")


CONTRACT_SQL = " union all ".join(
    [f"select '{c}' as column_name, 'ok' as status, count({'post_id' if c == 'id' else c}) as filled from posts"
     for c in K.POSTS_CONTRACT if c != "override"]
    + ["select 'override', 'missing', 0"]
    + [f"select '{c}', 'extra', count({c}) from posts" for c in ("n_executed", "decision", *K.STAGE_TIME_COLUMN.values())])


@query("schema_contract", using("posts", body=CONTRACT_SQL))
def _(spark, sf):
    posts = X.posts_table(spark, sf).withColumnRenamed("post_id", "id").drop("override", "comments")
    return P.schema_contract(posts)


EXPECTED_FIELDS = ["k", "page", "referrer"]


@query("column_diff", f"""
select case when e is null then a else e end as column_name, case when a is null then 'missing' else 'extra' end as status
from (select distinct unnest(json_keys(props)) as a from events) full join (select unnest({EXPECTED_FIELDS}) as e) on a = e
where a is null or e is null""")
def _(spark, sf):
    # the columns that the JSON of all events would have, against an expected list
    keys = F.explode(F.json_object_keys("props"))
    seen = read_table(spark, sf, "events").select(keys.alias("column_name")).distinct()
    wanted = spark.createDataFrame([(n,) for n in EXPECTED_FIELDS], "column_name string")
    return P.column_diff(seen, wanted)


@query("error_rows", using("analysed", body="""
select post_id, final_status, band, action, threat_level, round(confidence, 6) as confidence, stage, decision_model, reason,
  escalated, accepted, error from analysed"""))
def _(spark, sf):
    return X.analysis_rows(spark, sf).drop("doc_id", "created_at", "processing_time").withColumn(
        "confidence", F.round("confidence", 6))


@query("external_failure_fallback", using("posts_log", body=f"""
select post_id, case when outside then 'fallback' else 'quarantine' end as route, case when outside then true end as accepted,
  case when outside then '{K.FALLBACK_REASON}' else error end as reason, case when outside then 'low' end as threat_level,
  case when outside then 0.5::double end as confidence, case when outside then 'fallback' end as stage,
  case when outside then 'SAFE' end as band, case when outside then 'PASS' end as action,
  case when outside then '{K.FALLBACK_EXPLANATION}' end as explanation
from (select *, regexp_matches(lower(error), '404|not found|api|external|model') as outside from posts_log where error is not null)"""))
def _(spark, sf):
    failed = X.posts_log(spark, sf).filter("error is not null")
    return C.external_failure_fallback(failed, "post_id")
