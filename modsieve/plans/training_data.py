"""Queries: answers to lines, noise, sampling, de-duplication, quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.functions.text import copy_key
from modsieve.operators import training as T
from modsieve.plans import fixtures as X
from modsieve.plans.registry import query
from modsieve.plans.sqlviews import norm, strip, text_list, using

RESPONSE = "'1. Hello. World' || chr(10) || chr(10) || '---' || chr(10) || '  2. ' || text || chr(10) || 'no number here' || chr(10) || '3 . tail. end '"


@query("parse_llm_lines", f"""
select id, {strip("case when strpos(line, '.') > 0 then substr(line, strpos(line, '.') + 1) else line end")} as text
from (select id, {strip('line')} as line from (
  select doc_id as id, unnest(regexp_split_to_array({strip(RESPONSE)}, '\\r\\n|[\\n\\r\\x0B\\f\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]')) as line from documents))
where regexp_matches(line, '\\p{{L}}')""")
def _(spark, sf):
    return T.parse_lines(X.answer_lines(spark, sf)).select("id", "text")


TAILS, TAGS = text_list(K.NOISE_TAILS), text_list(K.NOISE_TAGS)


def noise_sql(kind: int, text: str = "text", choice: str = "noise_choice") -> str:
    upper = f"upper(replace({text}, 'ß', 'ss'))"
    return [
        f"case when {choice} % 3 = 2 then regexp_replace({text}, '^([^aeiou]*[aeiou])', '\\1x') else {text} end",
        f"{text} || [{TAILS}][{choice} % 4 + 1]",
        f"regexp_replace({text}, '^([^s]*)s', '\\1$')",
        f"case when {choice} % 2 = 0 then lower({text}) else {upper} end",
        f"{text} || [{TAGS}][{choice} % 3 + 1]",
    ][kind]


def register_noise(name: str, kind: int, build):
    @query(name, using("training", body=f"select id, {noise_sql(kind)} as text from training"))
    def _(spark, sf):
        rows = X.training_choices(X.training(spark, sf))
        return rows.select("id", build(F.col("text"), F.col("noise_choice")).alias("text"))


register_noise("noise_typo", 0, T.noise_typo)
register_noise("noise_suffix", 1, T.noise_suffix)
register_noise("noise_dollar", 2, lambda text, choice: T.noise_dollar(text))
register_noise("noise_case", 3, T.noise_case)
register_noise("noise_hashtag", 4, T.noise_hashtag)


def sampled(order: str, fraction: float, source: str = "training") -> str:
    return f"""select * from (select *, row_number() over (partition by label order by {order}, id) as rn,
      count(*) over (partition by label) as n from {source}) where rn <= floor(n * {fraction}::double)"""


@query("sample_fraction", using("training", body=f"select id, label from ({sampled('pick_order', K.PARAPHRASE_FRACTION)})"))
def _(spark, sf):
    rows = X.training_choices(X.training(spark, sf))
    return T.sample_fraction(rows, K.PARAPHRASE_FRACTION, "pick_order").select("id", "label")


@query("paraphrase_keep", using("training", "rewrites", body="""
select t.id, r.rewrite from training t join rewrites r using (id)
where r.rewrite <> '' and lower(r.rewrite) <> lower(t.text)"""))
def _(spark, sf):
    rows = X.training(spark, sf)
    return T.paraphrase_keep(rows.join(X.rewrites(rows), "id")).select("id", "rewrite")


@query("dedup_keep_first", using("training", body=f"""
select id, text from training where id in (select min(id) from training group by {norm('text')})"""))
def _(spark, sf):
    return T.dedup_keep_first(X.training(spark, sf)).select("id", "text")


@query("copy_groups", f"select count(*) as posts, min(doc_id) as first_id from documents group by {norm('text')}")
def _(spark, sf):
    from modsieve.session import read_table, spread

    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    groups = docs.groupBy(copy_key(F.col("text")).alias("copy")).agg(
        F.count("*").alias("posts"), F.min("doc_id").alias("first_id"))
    return groups.select("posts", "first_id")


@query("quota_per_label", using("training", body="""
select id, label from (select *, row_number() over (partition by label order by id) as rn from training)
where rn <= case label when 'PASS' then 300 when 'FLAG' then 225 else 225 end"""))
def _(spark, sf):
    return T.quota_per_label(X.training(spark, sf), {"PASS": 300, "FLAG": 225, "BLOCK": 225}).select("id", "label")


@query("shuffle_rows", using("training", body="select id, label from training"))
def _(spark, sf):
    return T.shuffle_rows(X.training(spark, sf).select("id", "label"), 42)


@query("label_union", using("training", body="""
select id, label, text from training where label = 'PASS'
union all select conv_id * 1000 + turn, 'FLAG', text from conversations union all select page_id, 'BLOCK', html from pages"""))
def _(spark, sf):
    # three sources, one scan each: documents, conversations and pages, numbered apart
    from modsieve.session import read_table

    posts = X.training(spark, sf).filter("label = 'PASS'").select("id", "label", "text")
    said = read_table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("FLAG").alias("label"), "text")
    pages = read_table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("BLOCK").alias("label"), F.col("html").alias("text"))
    return T.label_union([posts, said, pages])


#: Small enough to bind at every scale but the smallest.
BUILD_QUOTA = {"PASS": 300, "FLAG": 225, "BLOCK": 225}
_LIMIT = "case label " + " ".join(f"when '{name}' then {n}" for name, n in BUILD_QUOTA.items()) + " end"

BUILD_VIEWS = {
    "base": f"""select t.* from training t join (
      select id from (select id, label, row_number() over (partition by label order by id) as rn from training) where rn <= {_LIMIT}) using (id)""",
    "chosen": sampled("pick_order", K.PARAPHRASE_FRACTION, "base"),
    "pool": """select id, text, label, noise_order, noise_pattern, noise_choice from base union all
      select c.id + (select max(id) + 1 from base), r.rewrite, c.label, c.noise_order, c.noise_pattern, c.noise_choice
      from chosen c join rewrites r using (id) where r.rewrite <> '' and lower(r.rewrite) <> lower(c.text)""",
    "noisy": sampled("noise_order", K.NOISE_FRACTION, "pool"),
    "together": "select id, text, label from pool union all select id + 2 * (select max(id) + 1 from base), case noise_pattern "
    + " ".join(f"when {i} then {noise_sql(i)}" for i in range(5)) + " end, label from noisy",
    "firsts": f"select label, min(id) as id from together group by label, {norm('text')}",
    "placed": "select id, label, row_number() over (partition by label order by id) as rn from firsts",
}


@query("build_training_set", using("training", "rewrites", extra=BUILD_VIEWS, body=f"""
select p.id, p.label, t.text from (select id, label from placed where rn <= {_LIMIT}) p join together t on t.id = p.id"""))
def _(spark, sf):
    rows = X.training(spark, sf)
    built = T.build_training_set(X.training_choices(rows), X.rewrites(rows), BUILD_QUOTA)
    return built.select("id", "label", "text")
