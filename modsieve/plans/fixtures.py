"""Moderation inputs derived from the supplied tables.

The supplied documents hardly trigger a rule, so every document gets one of fourteen additions by
its id; all documents stay, whole.  Scores, answers, commands and labels that come from outside
services in production are derived here from the same tables, so that they grow with them.  The
stand-ins are not the models: they only make every branch of the cascade reachable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.operators import moderate
from modsieve.operators.cascade import TIME_COLUMNS, analysis_columns, decision_columns, stage_timings
from modsieve.operators.explanations import parse_explanation
from modsieve.operators.features import pattern_features
from modsieve.operators.lexicon import Lexicon
from modsieve.operators.providers import scorecard
from modsieve.operators.ranking import scattered
from modsieve.functions import text as T
from modsieve.session import read_table, spread

# class weights of the scorecard: PASS, FLAG, BLOCK
INTERCEPT = [1.0, 0.0, 0.0]
WEIGHTS = {
    "regex_match_0": [0.0, 0.0, 2.0],
    "regex_match_1": [0.0, 1.0, 0.0],
    "regex_match_2": [0.0, 0.0, 1.0],  # ties with PASS, which wins as the first
    "regex_match_4": [0.0, 2.0, 0.0],
    "phrase_act_now": [0.0, 0.5, 0.0],
    "phrase_guaranteed_returns": [0.0, 1.5, 2.5],
    "all_caps": [0.0, 1.5, 0.0],
    "starts_with_http": [0.0, 0.5, 0.0],
}


def pick(number: Column, choices: list[Column]) -> Column:
    """``choices[number]`` as a CASE chain, so unused branches cost nothing."""
    out = F.when(number == 0, choices[0])
    for position, choice in enumerate(choices[1:], start=1):
        out = out.when(number == position, choice)
    return out


def plant(documents: DataFrame) -> DataFrame:
    """``post_id, content`` from ``doc_id, text``."""
    text = F.col("text")

    def plus(tail: str) -> Column:
        return F.concat(text, F.lit(tail))

    planted = [
        plus(" Act now! guaranteed returns"), plus(" see https://promo.example/x"), plus(" send $5000 today"),
        plus(" s-c.a m m e r"), plus(" 1" + "Ab2" * 10), plus(" 0x" + "ab" * 20),
        plus(" GB29NWBK60161331926819"), plus(" " + "xy7" * 9),
        plus(" DM me for a 200% return on crypto, no risk"), plus(" You won a prize of cash @you #win ?"),
        plus(" make $5"), F.upper(text), F.concat(F.lit("http://a.example "), text), plus(" double money"),
    ]
    kind = F.col("doc_id") % 20
    return documents.select(F.col("doc_id").alias("post_id"),
                            F.coalesce(pick(kind, planted), text).alias("content"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plant(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    high = F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.7)
    return labels.select(
        F.col("doc_id").alias("post_id"),
        F.when(F.col("doc_id") % 3 == 0, "LABEL_1").otherwise("toxic").alias("label"),
        F.when(F.col("toxic") == 1, high).otherwise(0.1).alias("score"),
        F.when(F.col("doc_id") % 50 == 0, "scorer timeout").alias("error"),
    )


def sentiment_struct(content: Column, key: Column) -> Column:
    """A stand-in that reads the whole text: its blanks decide."""
    kind = T.count_char(content, " ") % 4
    return F.struct(
        F.when(kind < 2, "negative").when(kind == 2, "neutral").alias("label"),
        F.when(kind == 0, 0.95).when(kind == 1, 0.6).when(kind == 2, 0.7).alias("score"),
        F.when(key % 44 == 0, "scorer timeout").alias("error"),
    )


def verdict_response(content: Column) -> Column:
    """An answer that repeats the whole post and ends with a verdict, or none."""
    texts = ["FRAUD", " clean. ", "not sure", "This is NOT FRAUD", "FRAUD or CLEAN"]
    return F.concat(F.lit("Post: "), content, F.lit("\nAnswer: "), pick(T.count_char(content, "e") % 6, [F.lit(t) for t in texts]))


def wordy_explanation(content: Column) -> Column:
    """Answers that hold the whole post: as JSON between words, as plain text, after or before braces that are no JSON, or none at all."""
    good = F.to_json(F.struct(content.alias("explanation"), F.array(F.lit("act now"), F.lit("no risk")).alias("troublesome_words"), F.lit("Ask first").alias("suggestion")))
    return pick(T.count_char(content, "e") % 5, [
        F.concat(F.lit("Sure: "), good, F.lit(" ok")), F.concat(F.lit("Looks risky: "), content), F.concat(F.lit("{bad} "), content, F.lit(" }")),
        F.concat(content, F.lit("} {"))])


def explanation_response(key: Column) -> Column:
    good = 'Sure: {"explanation": "Promises too much", "troublesome_words": ["act now", "no risk"], "suggestion": "Ask first"} ok'
    texts = [good, "Looks risky", "{bad}", "} {"]
    return pick(key % 5, [F.lit(t) for t in texts])


def explanation_error(key: Column) -> Column:
    return F.when(key % 35 == 0, "quota exceeded")


def class_probs(key: Column) -> Column:
    """Scorecard probabilities; a few posts have none, as if the model were missing."""
    return F.when(key % 25 != 24, scorecard(WEIGHTS, INTERCEPT))


def scorecard_features(posts: DataFrame) -> DataFrame:
    """Only the features the scorecard weighs."""
    lower = F.lower(F.col("content"))
    wide = pattern_features(posts)
    return wide.withColumns({
        "phrase_act_now": F.contains(lower, F.lit("act now")).cast("int"),
        "phrase_guaranteed_returns": F.contains(lower, F.lit("guaranteed returns")).cast("int"),
        "all_caps": (F.col("content").rlike(r"\p{IsUppercase}")
                     & ~F.col("content").rlike(r"[\p{IsLowercase}\p{Lt}]")).cast("int"),
        "starts_with_http": T.starts_with_http(lower).cast("int"),
    })


def text_scores(posts: DataFrame) -> DataFrame:
    """Append the score columns that depend on the post alone."""
    own = posts.columns
    key = F.col("post_id")
    return scorecard_features(posts).withColumns({
        "class_probs": class_probs(key),
        "sentiment": sentiment_struct(F.col("content"), key),
        "verdict_response": verdict_response(F.col("content")),
    }).select(*own, "class_probs", "sentiment", "verdict_response")


def decide(posts: DataFrame, toxicity: DataFrame, keep_content: bool = False, lexicon: Lexicon | None = None) -> DataFrame:
    """The library's flow with the stand-in providers."""
    return moderate.decide(posts, toxicity, lexicon, text_scores, keep_content)


def decided(spark: SparkSession, sf_dir: str, keep_content: bool = False) -> DataFrame:
    return decide(planted(spark, sf_dir), toxicity_scores(spark, sf_dir), keep_content)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision table, one narrow row per document."""
    return decision_columns(decided(spark, sf_dir), "post_id", "n_executed")


def time_columns(key: Column) -> dict[str, Column]:
    """Stage seconds as data: they come from logs, not from fused code."""
    units = [(0.001, 7), (0.002, 5), (0.003, 3), (0.004, 4), (0.05, 6)]
    return {column: F.lit(unit) * (1 + key % modulus) for column, (unit, modulus) in zip(TIME_COLUMNS, units)}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return table.withColumn("ts", F.col("ts").cast("timestamp"))


def log_from(event_rows: DataFrame, decision_rows: DataFrame, n_posts: Column | int) -> DataFrame:
    """Events as posts: each event repeats the decision of one document at its own time."""
    timed = event_rows.select(
        F.col("event_id").alias("post_id"), F.col("ts").alias("created_at"),
        (F.col("event_id") % n_posts).alias("doc_id"),
        F.when(F.col("event_id") % 50 == 49, "upstream API timeout")
        .when(F.col("event_id") % 50 == 24, "disk full").alias("error"),
    )
    joined = timed.join(decision_rows.withColumnRenamed("post_id", "doc_id"), "doc_id")
    with_times = stage_timings(joined.withColumns(time_columns(F.col("post_id"))))
    total = F.lit(0.0)
    for column in TIME_COLUMNS:
        total = total + F.col(column)
    return with_times.withColumn("processing_time", total)


def posts_log(spark: SparkSession, sf_dir: str, with_gold: bool = False) -> DataFrame:
    """The log: one fact join.  Tables keyed by document are joined to each other first, where keys
    are unique; an event-heavy document then meets one join only, which adaptive execution can split.
    """
    n = read_table(spark, sf_dir, "documents").select(F.count("*")).scalar()
    rows = decisions(spark, sf_dir)
    if with_gold:
        rows = rows.join(gold(spark, sf_dir).withColumnRenamed("doc_id", "post_id"), "post_id")
    return log_from(events(spark, sf_dir), rows, n)


def analysis_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk-analysis rows of the log, ERROR rows included."""
    return analysis_columns(posts_log(spark, sf_dir), "post_id", "doc_id", "created_at", "processing_time")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    return read_table(spark, sf_dir, "documents").select(
        "doc_id",
        pick(key % 5, [F.lit(c) for c in K.GOLD_CATEGORIES]).alias("category"),
        F.when(key % 3 == 1, "BLOCK").when(key % 3 == 2, "PASS").alias("expected_output"),
    )


def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis rows with their expected category and output."""
    return analysis_columns(posts_log(spark, sf_dir, with_gold=True), "post_id", "doc_id", "created_at", "processing_time",
                            "category", "expected_output")


def posts_table(spark: SparkSession, sf_dir: str, keep_content: bool = True) -> DataFrame:
    """Full posts rows, one per document, explanations included."""
    key = F.col("post_id")
    answer = parse_explanation(explanation_response(key), explanation_error(key))
    return moderate.posts_rows(decided(spark, sf_dir, keep_content), time_columns(key), answer, F.timestamp_seconds(F.lit(1704067200) + key * 61))


def targets(spark: SparkSession, sf_dir: str) -> Column:
    """Commands point at documents, and a few at posts that do not exist."""
    return read_table(spark, sf_dir, "documents").select(F.count("*") + 50).scalar()


def command_target(spark: SparkSession, sf_dir: str) -> Column:
    return F.col("event_id") % targets(spark, sf_dir)


def override_commands(event_rows: DataFrame, n_targets: Column) -> DataFrame:
    kind = F.col("event_type")
    value = (
        F.when(kind == "click", "Rejected").when(kind == "error", "Accepted").when(kind == "view", "Flagged")
        .when(kind == "signup", "Maybe")
    )
    return event_rows.filter(kind != "purchase").select(
        (F.col("event_id") % n_targets).alias("post_id"), value.alias("override_value"), "ts",
        F.col("event_id").alias("seq"))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return override_commands(events(spark, sf_dir), targets(spark, sf_dir))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("event_id")
    text = F.when(number % 20 == 0, F.repeat(F.lit("x"), 501)).otherwise(F.concat(F.lit("note "), number.cast("string")))
    return events(spark, sf_dir).select(
        command_target(spark, sf_dir).alias("post_id"), text.alias("comments"), "ts", number.alias("seq"))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("post_id")
    label = F.when(key % 10 < 4, "PASS").when(key % 10 < 7, "FLAG").otherwise("BLOCK")
    return planted(spark, sf_dir).select(key.alias("id"), F.col("content").alias("text"), label.alias("label"))


def training_choices(rows: DataFrame) -> DataFrame:
    """Arithmetic in place of a random generator: repeatable, and the same in any SQL engine."""
    key = F.col("id")
    return rows.withColumns({
        "pick_order": scattered(key, 7), "noise_order": scattered(key, 11),
        "noise_pattern": (key * 7 + 3) % 5, "noise_choice": (key * 13 + 5) % 12,
    })


def rewrites(rows: DataFrame) -> DataFrame:
    """Provider rewrites: same but for case, empty, a real one, or no row at all."""
    kind = F.col("id") % 4
    return rows.filter(kind != 3).select(
        "id", F.when(kind == 0, F.upper("text")).when(kind == 1, F.lit(" "))
        .otherwise(F.concat(F.lit("In other words: "), "text")).alias("rewrite"))


def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered-list answers built around whole documents."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(F.col("doc_id").alias("id"), F.concat(
        F.lit("1. Hello. World\n\n---\n  2. "), F.col("text"), F.lit("\nno number here\n3 . tail. end ")).alias("response"))


def benchmark_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon that grows with the tables: all words of every benchmark item."""
    items = read_table(spark, sf_dir, "benchmark")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return items.select(F.col("item_id").alias("kw_idx"), F.array_join(words, " ").alias("keyword"))


def phrase_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger one: all words of every benchmark item, three at a time, the last ones possibly fewer."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    starts = F.sequence(F.lit(1), F.size("w"), F.lit(3))
    items = read_table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).filter(F.size("w") > 0)
    return items.select("item_id", F.posexplode(F.transform(starts, lambda s: F.array_join(F.slice("w", s, F.lit(3)), " "))).alias(
        "part", "keyword")).select((F.col("item_id") * (1 << 20) + F.col("part")).alias("kw_idx"), "keyword")
