"""The derived inputs and the cascade once more, as plain SQL for a second engine.

Written independently of the Spark operators: flat columns and CASE expressions instead of structs,
regular expressions in the dialect without look-around.
"""

from __future__ import annotations

from modsieve import constants as K

EDGE_L = r"(?:^|[^\p{L}\p{N}_])"
EDGE_R = r"(?:[^\p{L}\p{N}_]|$)"
WS = r"[\t\n\x0B\f\r \x1c-\x1f\x85\p{Z}]"
NWS = r"[^\t\n\x0B\f\r \x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

ADDRESS = {
    "bitcoin": EDGE_L + "[13][a-km-zA-HJ-NP-Z1-9]{25,34}" + EDGE_R,
    "ethereum": EDGE_L + "0x[a-fA-F0-9]{40}" + EDGE_R,
    "iban": EDGE_L + "[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}[A-Z0-9]{0,16}" + EDGE_R,
    "cash_tag": r"\$[a-zA-Z0-9]{3,20}" + EDGE_R,
    "long_token": EDGE_L + "[a-zA-Z0-9]{26,35}" + EDGE_R,
}
FEATURE = [
    EDGE_L + r"\p{Nd}{2,}%" + WS + "+(?:return|profit|gain|yield)" + EDGE_R,
    EDGE_L + "(?:bitcoin|ethereum|crypto)" + EDGE_R,
    r"make \$\p{Nd}+",
    EDGE_L + "(?:no|zero)" + WS + "+(?:risk|fees)" + EDGE_R,
    EDGE_L + r"(?:win|won|winner|prize)[^\p{L}\p{N}_\n](?:[^\n]*[^\p{L}\p{N}_\n])?(?:cash|money)" + EDGE_R,
]


def text_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def fuzzy(keyword: str) -> str:
    return ".{0,2}".join(c for c in keyword.lower() if c.isascii() and c.isalnum())


def squash(col: str) -> str:
    return f"regexp_replace(lower({col}), '[^a-z0-9]', '', 'g')"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^{WS}+|{WS}+$', '', 'g')"


def norm(col: str) -> str:
    return rf"lower(regexp_replace({col}, '[^\p{{L}}\p{{N}}_]+', '', 'g'))"


def ts_text(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S.%f')"


def case_of(expr: str, values: list, quote=True) -> str:
    parts = " ".join(f"when {i} then {'null' if v is None else chr(39) + v + chr(39) if quote else v}"
                     for i, v in enumerate(values))
    return f"case {expr} {parts} end"


_PLANTED = """
select doc_id as post_id, case doc_id % 20
  when 0 then text || ' Act now! guaranteed returns'
  when 1 then text || ' see https://promo.example/x'
  when 2 then text || ' send $5000 today'
  when 3 then text || ' s-c.a m m e r'
  when 4 then text || ' 1' || repeat('Ab2', 10)
  when 5 then text || ' 0x' || repeat('ab', 20)
  when 6 then text || ' GB29NWBK60161331926819'
  when 7 then text || ' ' || repeat('xy7', 9)
  when 8 then text || ' DM me for a 200% return on crypto, no risk'
  when 9 then text || ' You won a prize of cash @you #win ?'
  when 10 then text || ' make $5'
  when 11 then upper(replace(text, 'ß', 'ss'))
  when 12 then 'http://a.example ' || text
  when 13 then text || ' double money'
  else text end as content
from documents"""

_KEYWORD = "case " + " ".join(
    f"when regexp_matches(clean, '{fuzzy(k)}') then '{k}'" for k in K.DEFAULT_RULE_KEYWORDS) + " end"
_ADDR = " or ".join(f"regexp_matches(content, '{p}')" for p in ADDRESS.values())
_STAGE1 = f"""
select post_id, keyword, address, url,
  case when keyword is not null or address then 'BLOCK' when url then 'ESCALATE' else 'ACCEPT' end as d1,
  case when keyword is not null then 'lexical_rule: ' || keyword when address then 'lexical_rule: crypto_address'
       when url then 'lexical_rule: suspicious_url' else 'lexical_rule: passed' end as r1,
  case when keyword is not null then 0.9 when address then 0.8 when url then 0.6 else 1.0 end::double as c1,
  case when keyword is not null then 'high' when address or url then 'medium' else 'low' end as t1
from (select post_id, {_KEYWORD} as keyword, ({_ADDR}) as address,
             regexp_matches(content, 'https?://{NWS}') as url
      from (select post_id, content, {squash('content')} as clean from planted))"""

_WEIGHED = f"""
select post_id,
  regexp_matches(low, '{FEATURE[0]}')::int as m0, regexp_matches(low, '{FEATURE[1]}')::int as m1,
  regexp_matches(low, '{FEATURE[2]}')::int as m2, regexp_matches(low, '{FEATURE[4]}')::int as m4,
  contains(low, 'act now')::int as act, contains(low, 'guaranteed returns')::int as gua,
  (regexp_matches(content, '\\p{{Lu}}') and not regexp_matches(content, '[\\p{{Ll}}\\p{{Lt}}]'))::int as caps,
  starts_with(regexp_replace(low, '^{WS}+', ''), 'http')::int as http
from (select post_id, content, lower(content) as low from planted)"""

_PROBS = """
select post_id, case when post_id % 25 <> 24 then [e0 / (e0 + e1 + e2), e1 / (e0 + e1 + e2), e2 / (e0 + e1 + e2)] end as probs
from (select post_id, exp(1.0::double) as e0,
        exp((1.0 * m1 + 2.0 * m4 + 0.5 * act + 1.5 * gua + 1.5 * caps + 0.5 * http)::double) as e1,
        exp((2.0 * m0 + 1.0 * m2 + 2.5 * gua)::double) as e2
      from weighed)"""

_TOX = """
select doc_id as post_id, case when doc_id % 3 = 0 then 'LABEL_1' else 'toxic' end as tox_label,
  (case when toxic = 1 then case when doc_id % 2 = 0 then 0.9 else 0.7 end else 0.1 end)::double as tox_score,
  case when doc_id % 50 = 0 then 'scorer timeout' end as tox_error
from labels"""

_SENT = """
select post_id, case when kind < 2 then 'negative' when kind = 2 then 'neutral' end as sen_label,
  (case kind when 0 then 0.95 when 1 then 0.6 when 2 then 0.7 end)::double as sen_score, case when post_id % 44 = 0 then 'scorer timeout' end as sen_error
from (select post_id, (length(content) - length(replace(content, ' ', ''))) % 4 as kind from planted)"""

_ANSWERS = """
select post_id, 'Post: ' || content || chr(10) || 'Answer: ' || case (length(content) - length(replace(content, 'e', ''))) % 6 when 0 then 'FRAUD' when 1 then ' clean. '
  when 2 then 'not sure' when 3 then 'This is NOT FRAUD' when 4 then 'FRAUD or CLEAN' end as response
from planted"""

_STAGES = """
select s.post_id, d1, r1, c1, t1,
  case when probs is null then 'ACCEPT' when top = 3 then 'BLOCK' when top = 2 then 'ESCALATE' else 'ACCEPT' end as d2,
  case when probs is null then 'lgbm_model_unavailable' when top = 3 then 'lgbm_flagged_block'
       when top = 2 then 'lgbm_flagged_flag' else 'lgbm_passed' end as r2,
  case when probs is null then 0.5::double else list_max(probs) end as c2,
  case when probs is null then 'low' when top = 3 then 'high' when top = 2 then 'medium' else 'low' end as t2,
  case when tox then 'BLOCK' else 'ACCEPT' end as d3,
  case when tox_error is not null then 'toxicity: error' when tox_score is null then 'toxicity: model_unavailable'
       when tox then 'toxicity: ' || printf('%.3f', tox_score) else 'toxicity: passed' end as r3,
  case when tox_error is not null or tox_score is null then 0.5::double when tox then tox_score else 1.0::double - tox_score end as c3,
  case when not tox then 'low' when tox_score > 0.8 then 'high' else 'medium' end as t3,
  'ACCEPT' as d4,
  case when sen_error is not null then 'sentiment: error' when sen_score is null then 'sentiment: model_unavailable'
       when sen_label = 'negative' and sen_score > 0.8 then 'sentiment_warning: highly_negative_' || printf('%.3f', sen_score)
       else 'sentiment: ' || sen_label || '_' || printf('%.3f', sen_score) end as r4,
  case when sen_error is not null or sen_score is null then 0.5::double else sen_score end as c4,
  'low' as t4,
  verdict,
  case when verdict = 'FRAUD' or verdict = 'UNCERTAIN' or (verdict = 'ERROR' and flagged) then 'BLOCK' else 'ACCEPT' end as d5,
  case when verdict = 'ERROR' then case when flagged then 'llm: fallback_escalated_content' else 'llm: fallback_no_escalation' end
       when verdict = 'FRAUD' then 'llm: fraud_detected_cot' when verdict = 'CLEAN' then 'llm: clean_cot'
       else 'llm: uncertain_cot' end as r5,
  (case when verdict = 'ERROR' then case when flagged then 0.7 else 0.6 end when verdict in ('FRAUD', 'CLEAN') then 0.9 else 0.5 end)::double as c5,
  case when verdict = 'FRAUD' then 'high' when verdict = 'UNCERTAIN' or (verdict = 'ERROR' and flagged) then 'medium' else 'low' end as t5
from (
  select s.*, p.probs, list_position(p.probs, list_max(p.probs)) as top,
    x.tox_label, x.tox_score, x.tox_error, n.sen_label, n.sen_score, n.sen_error,
    coalesce(x.tox_error is null and lower(x.tox_label) in ('toxic', 'label_1') and x.tox_score >= 0.5, false) as tox,
    case when a.response is null then 'ERROR' when upper(a.response) like '%FRAUD%' then 'FRAUD'
         when upper(a.response) like '%CLEAN%' then 'CLEAN' else 'UNCERTAIN' end as verdict,
    d1 = 'ESCALATE' or (p.probs is not null and list_position(p.probs, list_max(p.probs)) = 2) as flagged
  from stage1 s join probs p using (post_id) left join tox x using (post_id)
    join sent n using (post_id) join answers a using (post_id)) s"""


def _chosen(letter: str) -> str:
    return "case n_executed " + " ".join(f"when {i} then {letter}{i}" for i in range(1, 6)) + " end"


_DECIDED = f"""
select *, decision = 'ACCEPT' as accepted,
  case threat_level when 'high' then 'DANGER' when 'medium' then 'WARNING' else 'SAFE' end as band,
  case decision when 'BLOCK' then 'BLOCK' when 'ESCALATE' then 'FLAG_MEDIUM' else 'PASS' end as action
from (select *, {_chosen('d')} as decision, {_chosen('r')} as reason, {_chosen('c')} as confidence,
        {_chosen('t')} as threat_level,
        {case_of('n_executed - 1', K.STAGE_ORDER)} as stage
      from (select *, case when d1 = 'BLOCK' then 1 when d2 = 'BLOCK' then 2 when d3 = 'BLOCK' then 3 when d4 = 'BLOCK' then 4 else 5 end as n_executed
            from stages))"""

_TRACE = " union all ".join(
    f"select post_id, {i} as position, '{stage}' as stage, d{i} as decision, r{i} as reason, c{i} as confidence, t{i} as threat_level "
    f"from decided where n_executed >= {i}" for i, stage in enumerate(K.STAGE_ORDER, start=1))

_UNITS = [("rulebased_time", "0.001", 7), ("lgbm_time", "0.002", 5), ("detoxify_time", "0.003", 3),
          ("finbert_time", "0.004", 4), ("llm_time", "0.05", 6)]


def _times(key: str) -> str:
    return ", ".join(
        f"case when n_executed >= {i} then {unit}::double * (1 + {key} % {m}) else 0.0::double end as {name}"
        for i, (name, unit, m) in enumerate(_UNITS, start=1))


_SUM = "rulebased_time + lgbm_time + detoxify_time + finbert_time + llm_time as processing_time"
_LOG = f"""
select *, {_SUM} from (
  select e.event_id as post_id, d.post_id as doc_id, e.ts as created_at, n_executed, decision, accepted, reason, threat_level,
    confidence, stage, band, action,
    case when e.event_id % 50 = 49 then 'upstream API timeout' when e.event_id % 50 = 24 then 'disk full' end as error,
    {_times('e.event_id')}
  from events e join decided d on e.event_id % (select count(*) from documents) = d.post_id)"""

_MODEL = "case stage " + " ".join(f"when '{s}' then '{n}'" for s, n in K.STAGE_DISPLAY.items()) + " else 'Unknown' end"
MODEL_SQL = _MODEL
ESCALATED = ("threat_level in ('medium', 'high') or confidence < 0.7 or stage in ('detoxify', 'finbert') "
             "or action in ('FLAG_LOW', 'FLAG_MEDIUM', 'FLAG_HIGH', 'BLOCK')")
_ROWS = f"""
select post_id, doc_id, created_at, processing_time, error,
  case when error is not null then 'Error' when band = 'SAFE' then 'Safe' else 'Unknown' end as final_status,
  case when error is null then band else 'ERROR' end as band, case when error is null then action else 'ERROR' end as action,
  case when error is null then threat_level else 'unknown' end as threat_level,
  case when error is null then confidence else 0.0::double end as confidence,
  case when error is null then stage else 'error' end as stage,
  case when error is null then {_MODEL} else 'Error' end as decision_model,
  case when error is null then reason else 'Analysis failed: ' || error end as reason,
  error is null and ({ESCALATED}) as escalated, error is null and accepted as accepted
from posts_log"""

_GOLD = f"""
select doc_id, {case_of('doc_id % 5', K.GOLD_CATEGORIES)} as category,
  case doc_id % 3 when 1 then 'BLOCK' when 2 then 'PASS' end as expected_output
from documents"""

_EXPLAINED = """
select *, case
    when err is not null then err when response is null then 'LLM request failed.' when kind = 0 then 'Promises too much'
    else response end as explanation,
  case when err is null and kind = 0 then ['act now', 'no risk'] else []::varchar[] end as words,
  case when err is null and kind = 0 then 'Ask first' else '' end as suggestion
from (select doc_id as post_id, doc_id % 5 as kind, case when doc_id % 35 = 0 then 'quota exceeded' end as err,
        case doc_id % 5 when 0 then 'Sure: {"explanation": "Promises too much", "troublesome_words": ["act now", "no risk"], "suggestion": "Ask first"} ok'
          when 1 then 'Looks risky' when 2 then '{bad}' when 3 then '} {' end as response
      from documents)"""

_POSTS = f"""
select *, {_SUM},
  timestamp '2024-01-01 00:00:00' + to_seconds(post_id * 61) as created_at, 'No' as override
from (select d.post_id, p.content, n_executed, decision, accepted, reason, threat_level, confidence, stage, band, action,
        case when action in ('BLOCK', 'FLAG_MEDIUM') then explanation else '' end as llm_explanation,
        case when action in ('BLOCK', 'FLAG_MEDIUM') then words else []::varchar[] end as llm_troublesome_words,
        case when action in ('BLOCK', 'FLAG_MEDIUM') then suggestion else '' end as llm_suggestion,
        {_times('d.post_id')}
      from decided d join planted p using (post_id) join explained x using (post_id))"""

_TARGET = "event_id % ((select count(*) from documents) + 50)"
_OVERRIDES = f"""
select {_TARGET} as post_id, case event_type when 'click' then 'Rejected' when 'error' then 'Accepted'
  when 'view' then 'Flagged' when 'signup' then 'Maybe' end as override_value, ts, event_id as seq
from events where event_type <> 'purchase'"""
_COMMENTS = f"""
select {_TARGET} as post_id, case when event_id % 20 = 0 then repeat('x', 501) else 'note ' || event_id end as comments,
  ts, event_id as seq from events"""

_TRAINING = """
select post_id as id, content as text, case when post_id % 10 < 4 then 'PASS' when post_id % 10 < 7 then 'FLAG' else 'BLOCK' end as label,
  ((post_id % 2147483647) * 48271 + 7) % 2147483647 as pick_order,
  ((post_id % 2147483647) * 48271 + 11) % 2147483647 as noise_order,
  (post_id * 7 + 3) % 5 as noise_pattern, (post_id * 13 + 5) % 12 as noise_choice
from planted"""
_REWRITES = f"""
select id, {strip('rewrite')} as rewrite from (
  select id, case id % 4 when 0 then upper(replace(text, 'ß', 'ss')) when 1 then ' ' else 'In other words: ' || text end as rewrite
  from training where id % 4 <> 3)"""

VIEWS: dict[str, tuple[list[str], str]] = {
    "planted": ([], _PLANTED),
    "stage1": (["planted"], _STAGE1),
    "weighed": (["planted"], _WEIGHED),
    "probs": (["weighed"], _PROBS),
    "tox": ([], _TOX),
    "sent": (["planted"], _SENT),
    "answers": (["planted"], _ANSWERS),
    "stages": (["stage1", "probs", "tox", "sent", "answers"], _STAGES),
    "decided": (["stages"], _DECIDED),
    "trace": (["decided"], _TRACE),
    "posts_log": (["decided"], _LOG),
    "analysed": (["posts_log"], _ROWS),
    "gold": ([], _GOLD),
    "gold_rows": (["analysed", "gold"], "select a.*, g.category, g.expected_output from analysed a join gold g using (doc_id)"),
    "explained": ([], _EXPLAINED),
    "posts": (["decided", "planted", "explained"], _POSTS),
    "overrides": ([], _OVERRIDES),
    "comments_cmd": ([], _COMMENTS),
    "training": (["planted"], _TRAINING),
    "rewrites": (["training"], _REWRITES),
}


def using(*names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the named views, and all they need, as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for other in VIEWS[name][0]:
            need(other)
        order.append(name)

    for name in names:
        need(name)
    parts = [f"{name} as ({VIEWS[name][1]})" for name in order]
    parts += [f"{name} as ({sql})" for name, sql in (extra or {}).items()]
    return "with " + ",\n".join(parts) + "\n" + body
