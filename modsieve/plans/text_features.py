"""Queries: tokens, counts, flags, TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.functions import text as T
from modsieve.operators import features as FT
from modsieve.operators import tfidf as V
from modsieve.plans import fixtures as X
from modsieve.plans.registry import query
from modsieve.plans.sqlviews import FEATURE, NWS, WORD, WS, text_list, using

STOP = text_list(K.STOP_WORDS)


def removed(col: str, mark: str) -> str:
    return f"(length({col}) - length(replace({col}, '{mark}', '')))"


def counted(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, '{pattern}'))"


COUNT_SQL = f"""
select post_id, num_words, num_chars,
  round(case when num_words > 0 then num_chars::double / num_words else 0 end, 6) as avg_word_len,
  num_upper, {removed('content', '!')} as num_exclaims, {removed('content', '?')} as num_questions,
  {counted('low', 'https?://' + NWS + '+')} as num_links, {removed('content', '@')} as num_mentions,
  {removed('content', '$')} as num_dollar, {removed('content', '#')} as num_hashtags,
  {counted('content', chr(92) + 'p{Nd}')} as num_digits, {counted('content', '[!-/:-@' + chr(92) + '[-`{-~]')} as num_punct,
  stopword_count, len(list_distinct(words)) as unique_words,
  (regexp_matches(content, '\\p{{Lu}}') and not regexp_matches(content, '\\p{{Ll}}'))::int as all_caps,
  starts_with(regexp_replace(low, '^{WS}+', ''), 'http')::int as starts_with_http,
  round(case when num_chars > 0 then num_upper::double / num_chars else 0 end, 6) as frac_upper,
  round(case when num_words > 0 then stopword_count::double / num_words else 0 end, 6) as frac_stopwords
from (select *, len(words) as num_words, length(content) as num_chars, {counted('content', chr(92) + 'p{Lu}')} as num_upper,
        len(list_filter(words, lambda w: w in ({STOP}))) as stopword_count
      from (select post_id, content, lower(content) as low, regexp_extract_all(lower(content), '{WORD}+') as words from planted))"""

FRACTIONS = ["avg_word_len", "frac_upper", "frac_stopwords"]


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in FRACTIONS if c in df.columns})


@query("tokens", using("planted", body=f"""
select post_id, array_to_string(regexp_extract_all(lower(content), '{WORD}+'), ' ') as tokens from planted"""))
def _(spark, sf):
    return X.planted(spark, sf).select("post_id", F.array_join(T.tokens(F.col("content")), " ").alias("tokens"))


@query("count_features", using("planted", body=COUNT_SQL))
def _(spark, sf):
    return rounded(FT.count_features(X.planted(spark, sf)).drop("content")).select("post_id", *FT.COUNT_FEATURES)


KEYWORD_SQL = "(" + " + ".join(
    f"(length(low) - length(replace(low, '{p}', ''))) // {len(p)}" for p in K.SCAM_PHRASES) + ")"


@query("keyword_features", using("planted", body=f"""
select post_id, (n > 0)::int as keyword_present, n as keyword_count
from (select post_id, {KEYWORD_SQL} as n from (select post_id, lower(content) as low from planted))"""))
def _(spark, sf):
    return FT.keyword_features(X.planted(spark, sf), K.SCAM_PHRASES).select("post_id", *FT.KEYWORD_FEATURES)


PHRASE_SQL = ", ".join(
    f"contains(lower(content), '{p}')::int as \"{n}\"" for n, p in zip(FT.PHRASE_FEATURES, K.SCAM_PHRASES))


@query("phrase_features", using("planted", body=f"select post_id, {PHRASE_SQL} from planted"))
def _(spark, sf):
    return FT.phrase_features(X.planted(spark, sf)).drop("content")


PATTERN_SQL = ", ".join(f"regexp_matches(lower(content), '{p}')::int as regex_match_{i}" for i, p in enumerate(FEATURE))


@query("pattern_features", using("planted", body=f"select post_id, {PATTERN_SQL} from planted"))
def _(spark, sf):
    return FT.pattern_features(X.planted(spark, sf)).drop("content")


TERMS_SQL = f"""
grams as (
  select id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term
  from (select id, list_filter(regexp_extract_all(lower(text), '{WORD}{{2,}}'), lambda x: x not in ({STOP})) as w from training))"""
FIT_SQL = """
fit as (
  select term, sum(c) as corpus_count, count(*) as doc_count,
    ln((1.0::double + (select count(*) from training)) / (1.0::double + count(*))) + 1.0::double as idf
  from (select term, id, count(*) as c from grams group by term, id) group by term having count(*) >= 2
  order by corpus_count desc, term limit 40)"""


def _cte(sql: str) -> str:
    return sql.strip().split("(", 1)[1][:-1]


FIT_VIEWS = {"grams": _cte(TERMS_SQL), "fit": _cte(FIT_SQL)}


@query("tfidf_fit", using("training", extra=FIT_VIEWS, body="""
select term, corpus_count::bigint as corpus_count, doc_count, round(idf, 6) as idf from fit"""))
def _(spark, sf):
    return V.tfidf_fit(X.training(spark, sf)).withColumn("idf", F.round("idf", 6))


TRANSFORM_VIEWS = {
    **FIT_VIEWS,
    "weighted": "select g.id, g.term, count(*) * any_value(f.idf) as w from grams g join fit f using (term) group by g.id, g.term",
    "entries": "select id, term, w / sqrt(sum(w * w) over (partition by id)) as weight from weighted",
}


@query("tfidf_transform", using("training", extra=TRANSFORM_VIEWS, body="""
select id, term, round(weight, 6) as weight from entries"""))
def _(spark, sf):
    rows = X.training(spark, sf)
    vocab = V.vocabulary(V.tfidf_fit(rows))
    return V.tfidf_entries(rows, vocab, "id").withColumn("weight", F.round("weight", 6))


def feature_rows(spark, sf):
    rows = FT.with_tokens(X.training(spark, sf), "text")
    vocab = V.vocabulary(V.tfidf_fit(rows, tokens="_tokens"))
    wide = V.tfidf_transform(FT.extract_features(rows, K.SCAM_PHRASES, "text", "_tokens"), vocab, tokens="_tokens")
    return wide, FT.BASE_FEATURES + [V.feature_name(term) for term, _ in vocab]


@query("feature_frame", using("training", "planted", extra={
    **TRANSFORM_VIEWS,
    "counts": COUNT_SQL,
    "keys": f"select post_id, {KEYWORD_SQL} as n from (select post_id, lower(content) as low from planted)",
    "phrases": f"select post_id, {PHRASE_SQL} from planted",
    "patterns": f"select post_id, {PATTERN_SQL} from planted",
    "tf": "select id, sum(weight) as tfidf_sum, count(*) as tfidf_terms from entries group by id",
}, body="select c.post_id as id, "
    + ", ".join(f"c.{n}::double as {n}" for n in FT.COUNT_FEATURES)
    + ", (n > 0)::int::double as keyword_present, n::double as keyword_count, "
    + ", ".join(f"p.\"{n}\"::double as \"{n}\"" for n in FT.PHRASE_FEATURES) + ", "
    + ", ".join(f"r.{n}::double as {n}" for n in FT.PATTERN_FEATURES)
    + ", round(coalesce(tfidf_sum, 0), 6)::double as tfidf_sum, coalesce(tfidf_terms, 0) as tfidf_terms"
    + " from counts c join keys k using (post_id) join phrases p using (post_id) join patterns r using (post_id)"
    + " left join tf on tf.id = c.post_id"))
def _(spark, sf):
    # vocabulary terms differ from table to table, so the forty weights are compared as sum and count
    wide, names = feature_rows(spark, sf)
    pinned = FT.feature_frame(wide, names, "id")
    weights = [F.col(f"`{n}`") for n in names[len(FT.BASE_FEATURES):]]
    total, used = F.lit(0.0), F.lit(0).cast("long")
    for w in weights:
        total, used = total + w, used + (w > 0).cast("long")
    return rounded(pinned.select("id", *[f"`{n}`" for n in FT.BASE_FEATURES],
                                 F.round(total, 6).alias("tfidf_sum"), used.alias("tfidf_terms")))
