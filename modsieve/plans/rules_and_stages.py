"""Queries: rules, stages, cascade, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.functions import labels as L
from modsieve.functions import patterns as P
from modsieve.functions import text as T
from modsieve.operators import cascade as C
from modsieve.operators import moderate
from modsieve.operators import stages as S
from modsieve.operators.explanations import parse_explanation
from modsieve.operators.keyword_index import indexed_hits
from modsieve.operators.lexicon import Lexicon, first_hit_per_post, first_hits, fuzzy_match, lexicon_hits
from modsieve.operators.providers import batch_scorer, masked, score_table
from modsieve.operators.rows import expand_with_position, filter_once
from modsieve.plans import fixtures as X
from modsieve.plans.registry import query
from modsieve.plans.sqlviews import ADDRESS, ESCALATED, MODEL_SQL, NWS, fuzzy, squash, ts_text, using
from modsieve.session import read_table, share_package, spread

RESULT = ["decision", "reason", "confidence", "threat_level"]


def flat(df, column, *keep):
    return df.select(*keep, *[F.col(column)[n].alias(n) for n in RESULT])


@query("planted_posts", using("planted", body="select post_id, content from planted"))
def _(spark, sf):
    return X.planted(spark, sf)


@query("fuzzy_keyword_match", using("planted", body=f"""
select post_id, regexp_matches({squash('content')}, '{fuzzy("scammer")}') as hit_scammer,
  regexp_matches({squash('content')}, '{fuzzy("double money")}') as hit_double_money from planted"""))
def _(spark, sf):
    return X.planted(spark, sf).select(
        "post_id", fuzzy_match(F.col("content"), "scammer").alias("hit_scammer"),
        fuzzy_match(F.col("content"), "double money").alias("hit_double_money"))


PHRASE_LIST = K.DEFAULT_RULE_KEYWORDS + K.SCAM_PHRASES


@query("first_keyword_hit", using("planted", body="select post_id, kw_idx from (select post_id, case " + " ".join(
    f"when regexp_matches(clean, '{fuzzy(k)}') then {i}" for i, k in enumerate(PHRASE_LIST))
    + f" end as kw_idx from (select post_id, {squash('content')} as clean from planted)) where kw_idx is not null"))
def _(spark, sf):
    return first_hits(X.planted(spark, sf), Lexicon.of(PHRASE_LIST)).select("post_id", "kw_idx")


_HITS = f"""
  select post_id, k.item_id as kw_idx, k.keyword
  from (select post_id, {squash('content')} as clean from planted) p
  join (select item_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') as keyword,
          array_to_string(regexp_extract_all(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ''), '.'), '.{{0,2}}') as pattern
        from benchmark) k on regexp_matches(p.clean, k.pattern)"""


@query("lexicon_hits", using("planted", body="select * from hits", extra={"hits": _HITS}))
def _(spark, sf):
    return lexicon_hits(X.planted(spark, sf), X.benchmark_keywords(spark, sf))


@query("lexicon_hits_indexed", using("planted", body="select * from hits", extra={"hits": _HITS}))
def _(spark, sf):
    return indexed_hits(X.planted(spark, sf), X.benchmark_keywords(spark, sf))


@query("first_hit_per_post", using("planted", body="""
select post_id, min(kw_idx) as kw_idx, arg_min(keyword, kw_idx) as keyword from hits group by post_id""", extra={"hits": _HITS}))
def _(spark, sf):
    return first_hit_per_post(lexicon_hits(X.planted(spark, sf), X.benchmark_keywords(spark, sf)))


# hundreds of keywords at the small scale, thousands above
_PHRASES = f"""
  select item_id * 1048576 + part - 1 as kw_idx, array_to_string(w[3 * part - 2:3 * part], ' ') as keyword,
    array_to_string(regexp_extract_all(array_to_string(w[3 * part - 2:3 * part], ''), '.'), '.{{0,2}}') as pattern
  from (select item_id, w, unnest(range(1, (len(w) + 2) // 3 + 1)) as part
        from (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from benchmark))"""


@query("first_keyword_hit_large", using("planted", body=f"""
select post_id, min(kw_idx) as kw_idx, arg_min(keyword, kw_idx) as keyword
from (select post_id, {squash('content')} as clean from planted) p join phrases k on regexp_matches(p.clean, k.pattern) group by post_id""",
                                        extra={"phrases": _PHRASES}))
def _(spark, sf):
    return first_hits(X.planted(spark, sf), X.phrase_keywords(spark, sf))


@query("crypto_address", using("planted", body="select post_id, array_to_string(list_filter(["
       + ", ".join(f"case when regexp_matches(content, '{p}') then '{n}' end" for n, p in ADDRESS.items())
       + "], lambda x: x is not null), ',') as kinds from planted"))
def _(spark, sf):
    return X.planted(spark, sf).select("post_id", F.array_join(P.address_kinds(F.col("content")), ",").alias("kinds"))


@query("url_check", using("planted", body=f"""
select post_id, regexp_matches(content, 'https?://{NWS}') as has_url,
  array_to_string(regexp_extract_all(content, 'https?://{NWS}+'), ' ') as urls from planted"""))
def _(spark, sf):
    text = F.col("content")
    return X.planted(spark, sf).select("post_id", P.has_url(text).alias("has_url"), F.array_join(P.urls(text), " ").alias("urls"))


@query("url_check_pages", f"""
select page_id, regexp_matches(url, 'https?://{NWS}') as url_hit, len(regexp_extract_all(html, 'https?://{NWS}+')) as html_urls from pages""")
def _(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", "url", "html")
    return pages.select("page_id", P.has_url(F.col("url")).alias("url_hit"), F.size(P.urls(F.col("html"))).alias("html_urls"))


@query("stage1_rules", using("stage1", body="""
select post_id, d1 as decision, r1 as reason, c1 as confidence, t1 as threat_level from stage1"""))
def _(spark, sf):
    stage = S.rules_stage()
    posts = stage.prepare(X.planted(spark, sf))
    return flat(posts.select("post_id", stage.decide(posts, []).alias("r")), "r", "post_id")


@query("stage1_rules_conversations", f"""
select conv_id, turn, case when kw is not null then 'lexical_rule: ' || kw when addr then 'lexical_rule: crypto_address'
  when url then 'lexical_rule: suspicious_url' else 'lexical_rule: passed' end as reason
from (select conv_id, turn, case {' '.join(f"when regexp_matches({squash('text')}, '{fuzzy(k)}') then '{k}'" for k in K.DEFAULT_RULE_KEYWORDS)} end as kw,
        ({' or '.join(f"regexp_matches(text, '{p}')" for p in ADDRESS.values())}) as addr,
        regexp_matches(text, 'https?://{NWS}') as url from conversations)""")
def _(spark, sf):
    stage = S.rules_stage(content="text")
    posts = stage.prepare(spread(read_table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn"))
    return posts.select("conv_id", "turn", stage.decide(posts, [])["reason"].alias("reason"))


@query("scorecard", using("probs", body="""
select post_id, round(probs[1], 6) as p_pass, round(probs[2], 6) as p_flag, round(probs[3], 6) as p_block from probs"""))
def _(spark, sf):
    scored = X.scorecard_features(X.planted(spark, sf)).select("post_id", X.class_probs(F.col("post_id")).alias("p"))
    return scored.select("post_id", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(["p_pass", "p_flag", "p_block"])])


@query("class_probs_to_decision", using("stages", body="""
select post_id, d2 as decision, r2 as reason, round(c2, 6) as confidence, t2 as threat_level from stages"""))
def _(spark, sf):
    scored = X.scorecard_features(X.planted(spark, sf)).select("post_id", X.class_probs(F.col("post_id")).alias("p"))
    out = flat(scored.select("post_id", S.classifier_decision(F.col("p")).alias("r")), "r", "post_id")
    return out.withColumn("confidence", F.round("confidence", 6))


def with_toxicity(spark, sf):
    keys = read_table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"))
    return score_table(keys, X.toxicity_scores(spark, sf), "toxicity")


@query("toxicity_decision", using("stages", body="""
select post_id, d3 as decision, r3 as reason, round(c3, 6) as confidence, t3 as threat_level from stages"""))
def _(spark, sf):
    t = F.col("toxicity")
    scored = with_toxicity(spark, sf).select("post_id", S.toxicity_decision(t["label"], t["score"], t["error"]).alias("r"))
    return flat(scored, "r", "post_id").withColumn("confidence", F.round("confidence", 6))


@query("sentiment_annotation", using("sent", "stages", body="""
select s.post_id, d4 as decision, r4 as reason, c4 as confidence, t4 as threat_level,
  case when sen_error is null and sen_score is not null then sen_label end as sentiment,
  case when sen_error is null then sen_score end as sentiment_confidence
from stages s join sent n using (post_id)"""))
def _(spark, sf):
    s = F.col("s")
    scored = X.planted(spark, sf).select("post_id", X.sentiment_struct(F.col("content"), F.col("post_id")).alias("s")).select(
        "post_id", S.sentiment_annotation(s["label"], s["score"], s["error"]).alias("r"))
    notes = F.col("r")["metadata"]
    return scored.select("post_id", *[F.col("r")[n].alias(n) for n in RESULT], notes["sentiment"].alias("sentiment"),
                         notes["sentiment_confidence"].try_cast("double").alias("sentiment_confidence"))


@query("llm_prompt", using("planted", "trace", extra={"seen": """
select post_id, string_agg(stage || ': ' || reason, chr(10) order by position) as said from trace where position <= 4 group by post_id"""}, body="""
select post_id, 'Decide whether this post is financial fraud.' || chr(10) || 'Post: ' || content || chr(10) || 'Earlier findings:' || chr(10) || said
  || chr(10) || 'Harmless talk about money is fine. Answer with one word, FRAUD or CLEAN.' as prompt from planted join seen using (post_id)"""))
def _(spark, sf):
    run = X.decided(spark, sf, keep_content=True)
    return run.select("post_id", S.verdict_prompt(F.col("content"), F.slice("trace", 1, 4)).alias("prompt"))


@query("llm_verdict_parse", using("stages", body="""
select post_id, verdict, (case when verdict in ('FRAUD', 'CLEAN') then 0.9 else 0.5 end)::double as confidence from stages"""))
def _(spark, sf):
    said = X.planted(spark, sf).select("post_id", S.verdict_of(X.verdict_response(F.col("content"))).alias("verdict"))
    return said.withColumn("confidence", S.verdict_confidence(F.col("verdict")))


def reached_verdict(spark, sf):
    steps = filter_once(X.decided(spark, sf), F.col("n_executed") == 5)
    return steps.select("post_id", F.get("trace", F.lit(4)).alias("r"))


@query("llm_fallback", using("decided", body="""
select post_id, d5 as decision, r5 as reason, c5 as confidence, t5 as threat_level from decided where n_executed = 5 and verdict = 'ERROR'"""))
def _(spark, sf):
    return flat(reached_verdict(spark, sf), "r", "post_id").filter(F.col("reason").startswith("llm: fallback"))


@query("stage5_decision", using("decided", body="""
select post_id, d5 as decision, r5 as reason, c5 as confidence, t5 as threat_level from decided where n_executed = 5"""))
def _(spark, sf):
    return flat(reached_verdict(spark, sf), "r", "post_id")


DECISION_SQL = """select post_id, n_executed, decision, accepted, reason, threat_level, round(confidence, 6) as confidence,
  stage, band, action from decided"""


@query("cascade_resolve", using("decided", body=DECISION_SQL))
def _(spark, sf):
    return X.decisions(spark, sf).withColumn("confidence", F.round("confidence", 6))


@query("stage_trace", using("trace", body="""
select post_id, position, stage, decision, reason, round(confidence, 6) as confidence, threat_level from trace"""))
def _(spark, sf):
    return C.stage_trace(X.decided(spark, sf), "post_id").withColumn("confidence", F.round("confidence", 6))


TIMES = ["rulebased_time", "lgbm_time", "detoxify_time", "finbert_time", "llm_time"]


@query("stage_timings", using("posts_log", body="select post_id, n_executed, "
       + ", ".join(f"round({t}, 6) as {t}" for t in TIMES) + " from posts_log"))
def _(spark, sf):
    return X.posts_log(spark, sf).select("post_id", "n_executed", *[F.round(t, 6).alias(t) for t in TIMES])


@query("custom_stage_list", using("stages", body="""
select post_id, case when d3 = 'BLOCK' then 'BLOCK' else d1 end as decision, case when d3 = 'BLOCK' then r3 else r1 end as reason,
  case when d3 = 'BLOCK' then 1 else 2 end as n_executed from stages"""))
def _(spark, sf):
    # another order, fewer stages: toxicity first, rules last; here a final ESCALATE is possible
    stages = C.Cascade().register(S.toxicity_stage()).register(S.rules_stage())
    posts = score_table(X.planted(spark, sf), X.toxicity_scores(spark, sf), "toxicity")
    return stages.run(posts).select("post_id", F.col("outcome")["decision"].alias("decision"),
                                    F.col("outcome")["reason"].alias("reason"), "n_executed")


@query("empty_stage_list", using("planted", body="""
select post_id, 'ACCEPT' as decision, 'pipeline' as stage, 'all_stages_passed' as reason, 1.0::double as confidence from planted"""))
def _(spark, sf):
    run = C.Cascade().run(X.planted(spark, sf))
    return run.select("post_id", *[F.col("outcome")[n].alias(n) for n in ("decision", "stage", "reason", "confidence")])


@query("model_status", using("trace", body="""
select stage_number, s.stage, count(t.post_id) as posts, (select count(*) from registered) as pipeline_stages
from registered s left join trace t using (stage) group by 1, 2""", extra={"registered": "select * from (values "
    + ", ".join(f"({k}, '{n}')" for k, n in enumerate([*moderate.default_cascade().names(), "Stage6_Custom"], start=1)) + ") v(stage_number, stage)"}))
def _(spark, sf):
    # one registered stage more than any post reaches: it is reported all the same
    cascade = moderate.default_cascade().register(S.Stage("Stage6_Custom", lambda posts, earlier: F.lit(None)))
    return C.model_status(cascade, C.stage_trace(X.decided(spark, sf), "post_id"))


@query("explanation_request", using("decided", "planted", body="""
select post_id, action, 'A post was held back.' || chr(10) || 'Post:' || chr(10) || content || chr(10)
  || 'Say in one or two plain sentences what is wrong with it, list the words that cause it and offer a friendlier wording.'
  || ' Answer with JSON only, fields explanation, troublesome_words, suggestion.' as prompt
from decided join planted using (post_id) where action in ('BLOCK', 'FLAG_MEDIUM')"""))
def _(spark, sf):
    return moderate.explanation_requests(X.planted(spark, sf), X.decided(spark, sf))


@query("analysis_record", using("posts", body=f"""
select post_id, case when length(content) > 200 then content[1:200] || '...' else content end as content, content as full_content,
  {ts_text('created_at')} as timestamp, round(processing_time, 6) as processing_time,
  case when error is not null then 'Error' when band = 'SAFE' then 'Safe' else 'Unknown' end as final_status,
  case when error is null then band else 'ERROR' end as band, case when error is null then action else 'ERROR' end as action,
  case when error is null then threat_level else 'unknown' end as threat_level, round(case when error is null then confidence else 0 end, 6) as confidence,
  case when error is null then stage else 'error' end as stage, case when error is null then {MODEL_SQL} else 'Error' end as decision_model,
  case when error is null then reason else 'Analysis failed: ' || error end as reason, error is null and ({ESCALATED}) as escalated,
  error is null and accepted as accepted, error, '2024-02-01T00:00:00' as analysis_timestamp
from (select *, case when post_id % 50 = 49 then 'upstream API timeout' end as error from posts)"""))
def _(spark, sf):
    rows = X.posts_table(spark, sf).withColumn("error", F.when(F.col("post_id") % 50 == 49, "upstream API timeout"))
    record = moderate.analysis_record(rows, F.lit("2024-02-01T00:00:00"))
    return record.withColumns({c: F.round(c, 6) for c in ("processing_time", "confidence")})


@query("explanation_parse", using("planted", extra={"answered": """
select *, regexp_extract(response, '(?s)\\{.*\\}') as document, case when post_id % 35 = 0 then 'quota exceeded' end as err from (
  select post_id, content, kind, case kind when 0 then 'Sure: ' || to_json({'explanation': content, 'troublesome_words': ['act now', 'no risk'], 'suggestion': 'Ask first'}) || ' ok'
    when 1 then 'Looks risky: ' || content when 2 then '{bad} ' || content || ' }' when 3 then content || '} {' end as response
  from (select *, (length(content) - length(replace(content, 'e', ''))) % 5 as kind from planted))""", "read": """
select *, err is null and response is not null and document <> '' and json_valid(document) as readable from answered"""}, body="""
select post_id, case when err is not null then err when response is null then 'LLM request failed.' when readable then coalesce(document::json->>'$.explanation', '')
    else response end as explanation,
  case when readable then coalesce(array_to_string(from_json(document::json->'$.troublesome_words', '["varchar"]'), '|'), '') else '' end as troublesome_words,
  case when readable then coalesce(document::json->>'$.suggestion', '') else '' end as suggestion
from read"""))
def _(spark, sf):
    answer = parse_explanation(X.wordy_explanation(F.col("content")), X.explanation_error(F.col("post_id")))
    parsed = X.planted(spark, sf).select("post_id", answer.alias("a"))
    return parsed.select("post_id", F.col("a")["explanation"].alias("explanation"),
                         F.array_join(F.col("a")["troublesome_words"], "|").alias("troublesome_words"),
                         F.col("a")["suggestion"].alias("suggestion"))


def upper_share(texts):
    """A stand-in for a text model: how much of a text is in capitals or digits."""
    import pandas as pd

    marked, size = texts.str.count("[A-Z0-9]"), texts.str.len()
    return pd.DataFrame({"label": (marked * 50 > size).map({True: "toxic", False: "fine"}), "score": marked / size.where(size > 0, 1)})


@query("text_model_scores", using("stage1", "planted", extra={"asked": """
select post_id, case when s.d1 <> 'BLOCK' then p.content end as content from stage1 s join planted p using (post_id)"""}, body="""
select post_id, content is null as skipped, case when marked * 50 > size then 'toxic' when content is not null then 'fine' end as label,
  round(marked::double / greatest(size, 1), 9) as score, content is not null as timed
from (select *, length(regexp_replace(content, '[^A-Z0-9]', '', 'g')) as marked, length(content) as size from asked)"""))
def _(spark, sf):
    # a model in the plan: whole texts in Arrow batches, none of posts the rules have blocked
    share_package(spark)
    rules = S.rules_stage()
    posts = rules.prepare(X.planted(spark, sf))
    ruled = posts.select("post_id", "content", rules.decide(posts, []).alias("rules"))
    model = batch_scorer(lambda: upper_share, "label string, score double, seconds double", timed="seconds")
    asked = masked(F.col("content"), [F.col("rules")])
    scored = ruled.select("post_id", asked.isNull().alias("skipped"), model(asked).alias("m"))
    return scored.select("post_id", "skipped", F.col("m")["label"].alias("label"), F.round(F.col("m")["score"], 9).alias("score"),
                         F.coalesce(F.col("m")["seconds"] >= 0, F.lit(False)).alias("timed"))


@query("moderate", using("posts", body="""
select post_id, content, accepted, reason, threat_level, round(confidence, 6) as confidence, stage, band, action,
  round(processing_time, 6) as processing_time, override, llm_explanation,
  array_to_string(llm_troublesome_words, '|') as llm_troublesome_words, llm_suggestion from posts"""))
def _(spark, sf):
    return X.posts_table(spark, sf).select(
        "post_id", "content", "accepted", "reason", "threat_level", F.round("confidence", 6).alias("confidence"), "stage",
        "band", "action", F.round("processing_time", 6).alias("processing_time"), "override", "llm_explanation",
        F.array_join("llm_troublesome_words", "|").alias("llm_troublesome_words"), "llm_suggestion")


# ---- labels -------------------------------------------------------------------------------------

def steps(spark, sf):
    return C.stage_trace(X.decided(spark, sf), "post_id")


@query("decision_to_action", using("trace", body="""select post_id, position, decision,
  case decision when 'BLOCK' then 'BLOCK' when 'ESCALATE' then 'FLAG_MEDIUM' else 'PASS' end as action from trace"""))
def _(spark, sf):
    return steps(spark, sf).select("post_id", "position", "decision", L.action_of(F.col("decision")).alias("action"))


@query("decision_to_accepted", using("trace", body="""
select post_id, position, decision, decision = 'ACCEPT' as accepted from trace"""))
def _(spark, sf):
    return steps(spark, sf).select("post_id", "position", "decision", L.accepted_of(F.col("decision")).alias("accepted"))


@query("threat_to_band", using("trace", body="""select post_id, position, threat_level,
  case threat_level when 'high' then 'DANGER' when 'medium' then 'WARNING' else 'SAFE' end as band from trace"""))
def _(spark, sf):
    return steps(spark, sf).select("post_id", "position", "threat_level", L.band_of(F.col("threat_level")).alias("band"))


@query("final_status", using("decided", body="""
select post_id, band, case when band = 'SAFE' then 'Safe' else 'Unknown' end as final_status,
  case action when 'BLOCK' then 'Block' when 'FLAG_MEDIUM' then 'Flag Medium' else 'Unknown' end as action_status from decided"""))
def _(spark, sf):
    return X.decisions(spark, sf).select("post_id", "band", L.status_of(F.col("band")).alias("final_status"),
                                         L.status_of(F.col("action")).alias("action_status"))


@query("decision_model", using("decided", body="select post_id, stage, case stage " + " ".join(
    f"when '{s}' then '{n}'" for s, n in K.STAGE_DISPLAY.items()) + " else 'Unknown' end as decision_model from decided"))
def _(spark, sf):
    return X.decisions(spark, sf).select("post_id", "stage", L.model_of(F.col("stage")).alias("decision_model"))


@query("escalated", using("trace", body="""
select post_id, position, (threat_level <> 'low' or confidence < 0.7 or decision <> 'ACCEPT') as escalated from trace"""))
def _(spark, sf):
    s = steps(spark, sf)
    return s.select("post_id", "position", L.is_escalated(
        F.col("threat_level"), F.col("confidence"), F.col("stage"), L.action_of(F.col("decision"))).alias("escalated"))


@query("snippet", using("planted", body="""
select post_id, case when length(content) > 200 then content[1:200] || '...' else content end as snippet_200,
  case when length(content) > 100 then content[1:100] || '...' else content end as snippet_100 from planted"""))
def _(spark, sf):
    text = F.col("content")
    return X.planted(spark, sf).select("post_id", T.snippet(text, 200).alias("snippet_200"), T.snippet(text, 100).alias("snippet_100"))


@query("result_record", using("trace", body="""
select post_id, position, stage, decision, reason, round(confidence, 6) as confidence, threat_level from trace"""))
def _(spark, sf):
    # to a JSON document and back
    kept = expand_with_position(X.decided(spark, sf), "trace", "position", "step", "post_id")
    back = kept.select("post_id", (F.col("position") + 1).alias("position"),
                       F.from_json(C.result_record(F.col("step")), S.RESULT_TYPE).alias("r"))
    return back.select("post_id", "position", F.col("r")["stage"].alias("stage"), *[F.col("r")[n].alias(n) for n in RESULT]
                       ).withColumn("confidence", F.round("confidence", 6))


@query("needs_explanation", using("decided", body="""
select post_id, action, upper(action) in ('BLOCK', 'FLAG', 'FLAG_LOW', 'FLAG_MEDIUM', 'FLAG_HIGH') as needed from decided"""))
def _(spark, sf):
    return X.decisions(spark, sf).select("post_id", "action", L.needs_explanation(F.col("action")).alias("needed"))


@query("label_encode", using("training", body="""
select id, label, case label when 'PASS' then 0 when 'FLAG' then 1 when 'BLOCK' then 2 end as code from training"""))
def _(spark, sf):
    return X.training(spark, sf).select("id", "label", L.class_code(F.col("label")).alias("code"))


@query("label_decode", using("probs", body="""
select post_id, case list_position(probs, list_max(probs)) when 1 then 'PASS' when 2 then 'FLAG' when 3 then 'BLOCK' end as label
from probs where probs is not null"""))
def _(spark, sf):
    scored = X.scorecard_features(X.planted(spark, sf)).select("post_id", X.class_probs(F.col("post_id")).alias("p"))
    best = F.array_position("p", F.array_max("p")) - 1
    return scored.filter("p is not null").select("post_id", L.class_label(best).alias("label"))


@query("label_of_result", using("trace", body="""select post_id, position,
  case decision when 'ACCEPT' then 'Accepted' when 'ESCALATE' then 'Flagged' else 'Rejected' end as label from trace"""))
def _(spark, sf):
    d = F.col("decision")
    return steps(spark, sf).select("post_id", "position", L.review_label(L.accepted_of(d), L.action_of(d)).alias("label"))


@query("confidence_bucket", using("trace", body="""select post_id, position,
  case when confidence < 0.2 then 0 when confidence < 0.4 then 1 when confidence < 0.6 then 2 when confidence < 0.8 then 3 else 4 end as bucket,
  floor(confidence * 100 + 0.5)::bigint as percent from trace"""))
def _(spark, sf):
    c = F.col("confidence")
    return steps(spark, sf).select("post_id", "position", L.confidence_bucket(c).alias("bucket"), L.percent_half_up(c).alias("percent"))


@query("expected_rejected", using("gold", body="""
select doc_id, category, category in ('spam', 'fraud', 'profane') as expected_rejected from gold"""))
def _(spark, sf):
    return X.gold(spark, sf).select("doc_id", "category", L.expect_rejected(F.col("category")).alias("expected_rejected"))


@query("expected_output_check", using("gold_rows", body="""
select post_id, expected_output, action as actual_output, expected_output = action as is_correct,
  case when expected_output is null then 'NO_EXPECTED_OUTPUT' else 'EXPECTED_OUTPUT' end as accuracy_type from gold_rows"""))
def _(spark, sf):
    e = F.col("expected_output")
    return X.gold_rows(spark, sf).select(
        "post_id", "expected_output", F.col("action").alias("actual_output"),
        L.expectation_match(e, F.col("action")).alias("is_correct"), L.expectation_kind(e).alias("accuracy_type"))
