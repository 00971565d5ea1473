"""The decision stages.  Each one is a column that holds a result struct; no stage runs a job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.functions.patterns import has_address, has_url
from modsieve.functions.text import decimals3, squash, strip
from modsieve.operators.lexicon import Lexicon

RESULT_TYPE = (
    "struct<decision:string,stage:string,reason:string,confidence:double,"
    "threat_level:string,metadata:map<string,string>>"
)


def result(decision: str, stage: str, reason: Column | str, confidence: Column | float, threat: Column | str,
           metadata: Column | None = None) -> Column:
    """One stage result.  Strings are constants, columns are taken per row."""
    return F.struct(
        F.lit(decision).alias("decision"),
        F.lit(stage).alias("stage"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).cast("double").alias("confidence"),
        (F.lit(threat) if isinstance(threat, str) else threat).alias("threat_level"),
        (metadata if metadata is not None else F.create_map().cast("map<string,string>")).alias("metadata"),
    )


# A stage sees the posts and the result columns of the stages before it, and answers with one column.
Decide = Callable[[DataFrame, list[Column]], Column]


@dataclass(frozen=True)
class Stage:
    """A named step of a cascade; ``prepare`` may add input columns, ``decide`` builds the result."""

    name: str
    decide: Decide
    prepare: Callable[[DataFrame], DataFrame] | None = None


def rules_stage(lexicon: Lexicon | None = None, content: str = "content") -> Stage:
    """Keywords, then payment addresses, then links, else pass."""
    words = lexicon if lexicon is not None else Lexicon.default()

    def prepare(posts: DataFrame) -> DataFrame:
        squashed = posts.withColumn("_squashed", squash(F.col(content)))
        return squashed.withColumn("_keyword", words.keyword_at(words.first_hit(F.col("_squashed")))).drop("_squashed")

    def decide(posts: DataFrame, earlier: list[Column]) -> Column:
        text, keyword = F.col(content), F.col("_keyword")
        return (
            F.when(keyword.isNotNull(),
                   result("BLOCK", K.STAGE_RULES, F.concat(F.lit("lexical_rule: "), keyword), 0.9, "high"))
            .when(has_address(text), result("BLOCK", K.STAGE_RULES, "lexical_rule: crypto_address", 0.8, "medium"))
            .when(has_url(text), result("ESCALATE", K.STAGE_RULES, "lexical_rule: suspicious_url", 0.6, "medium"))
            .otherwise(result("ACCEPT", K.STAGE_RULES, "lexical_rule: passed", 1.0, "low"))
        )

    return Stage(K.STAGE_RULES, decide, prepare)


def classifier_decision(probs: Column) -> Column:
    """Largest of three class probabilities, the first one on ties; no probabilities, no model."""
    best = F.array_position(probs, F.array_max(probs))
    confidence = F.array_max(probs)
    return (
        F.when(probs.isNull(), result("ACCEPT", K.STAGE_CLASSIFIER, "lgbm_model_unavailable", 0.5, "low"))
        .when(best == 3, result("BLOCK", K.STAGE_CLASSIFIER, "lgbm_flagged_block", confidence, "high"))
        .when(best == 2, result("ESCALATE", K.STAGE_CLASSIFIER, "lgbm_flagged_flag", confidence, "medium"))
        .otherwise(result("ACCEPT", K.STAGE_CLASSIFIER, "lgbm_passed", confidence, "low"))
    )


def classifier_stage(probs: str = "class_probs") -> Stage:
    return Stage(K.STAGE_CLASSIFIER, lambda posts, earlier: classifier_decision(F.col(probs)))


def toxicity_decision(label: Column, score: Column, error: Column, threshold: float = 0.5) -> Column:
    toxic = F.lower(label).isin(*K.TOXIC_LABELS) & (score >= threshold)
    return (
        F.when(error.isNotNull(), result("ACCEPT", K.STAGE_TOXICITY, "toxicity: error", 0.5, "low"))
        .when(score.isNull(), result("ACCEPT", K.STAGE_TOXICITY, "toxicity: model_unavailable", 0.5, "low"))
        .when(toxic, result("BLOCK", K.STAGE_TOXICITY, F.concat(F.lit("toxicity: "), decimals3(score)), score,
                            F.when(score > 0.8, "high").otherwise("medium")))
        .otherwise(result("ACCEPT", K.STAGE_TOXICITY, "toxicity: passed", F.lit(1.0) - score, "low"))
    )


def toxicity_stage(scores: str = "toxicity", threshold: float = 0.5) -> Stage:
    """``scores`` names a struct column ``label, score, error``; null means the scorer was not there."""
    return Stage(K.STAGE_TOXICITY, lambda posts, earlier: toxicity_decision(
        F.col(scores)["label"], F.col(scores)["score"], F.col(scores)["error"], threshold))


def sentiment_annotation(label: Column, score: Column, error: Column) -> Column:
    """Never blocks; a strongly negative post only gets another reason."""
    notes = F.create_map(F.lit("sentiment"), label, F.lit("sentiment_confidence"), score.cast("string"))
    grim = (label == "negative") & (score > 0.8)
    return (
        F.when(error.isNotNull(), result("ACCEPT", K.STAGE_SENTIMENT, "sentiment: error", 0.5, "low"))
        .when(score.isNull(), result("ACCEPT", K.STAGE_SENTIMENT, "sentiment: model_unavailable", 0.5, "low"))
        .when(grim, result("ACCEPT", K.STAGE_SENTIMENT,
                           F.concat(F.lit("sentiment_warning: highly_negative_"), decimals3(score)),
                           score, "low", notes))
        .otherwise(result("ACCEPT", K.STAGE_SENTIMENT,
                          F.concat(F.lit("sentiment: "), label, F.lit("_"), decimals3(score)), score, "low", notes))
    )


def sentiment_stage(scores: str = "sentiment") -> Stage:
    return Stage(K.STAGE_SENTIMENT, lambda posts, earlier: sentiment_annotation(
        F.col(scores)["label"], F.col(scores)["score"], F.col(scores)["error"]))


def verdict_of(response: Column) -> Column:
    """FRAUD wins over CLEAN wherever they stand in the answer; no answer is an ERROR."""
    return verdict_said(F.upper(response), response)


def verdict_said(said: Column, response: Column) -> Column:
    """:func:`verdict_of` for an answer whose upper case is a column already, so that it is made once."""
    return (
        F.when(response.isNull(), "ERROR")
        .when(said.contains("FRAUD"), "FRAUD")
        .when(said.contains("CLEAN"), "CLEAN")
        .otherwise("UNCERTAIN")
    )


def verdict_confidence(verdict: Column) -> Column:
    return F.when(verdict.isin("FRAUD", "CLEAN"), 0.9).otherwise(0.5)


def any_escalated(earlier: list[Column]) -> Column:
    out = F.lit(False)
    for step in earlier:
        out = out | (step["decision"] == "ESCALATE")
    return out


def verdict_decision(verdict: Column, escalated: Column) -> Column:
    return (
        F.when((verdict == "ERROR") & escalated,
               result("BLOCK", K.STAGE_VERDICT, "llm: fallback_escalated_content", 0.7, "medium"))
        .when(verdict == "ERROR", result("ACCEPT", K.STAGE_VERDICT, "llm: fallback_no_escalation", 0.6, "low"))
        .when(verdict == "FRAUD", result("BLOCK", K.STAGE_VERDICT, "llm: fraud_detected_cot", 0.9, "high"))
        .when(verdict == "CLEAN", result("ACCEPT", K.STAGE_VERDICT, "llm: clean_cot", 0.9, "low"))
        .otherwise(result("BLOCK", K.STAGE_VERDICT, "llm: uncertain_cot", 0.5, "medium"))
    )


def with_verdict(posts: DataFrame, response: str = "verdict_response") -> DataFrame:
    """Append ``_verdict``."""
    said = posts.withColumn("_said", F.upper(F.col(response)))
    return said.withColumn("_verdict", verdict_said(F.col("_said"), F.col(response))).drop("_said")


def verdict_stage(response: str | None = "verdict_response") -> Stage:
    """``response`` names the answers; None if the posts have their ``_verdict`` already (:func:`with_verdict`)."""
    return Stage(K.STAGE_VERDICT, lambda posts, earlier: verdict_decision(F.col("_verdict"), any_escalated(earlier)),
                 None if response is None else lambda posts: with_verdict(posts, response))


def verdict_prompt(content: Column, trace: Column, suggestion: Column | None = None) -> Column:
    """The question put to a language model: the post, what earlier stages said, one-word answer."""
    seen = F.array_join(
        F.transform(trace, lambda s: F.concat(s["stage"], F.lit(": "), s["reason"])), "\n")
    note = F.lit("")
    if suggestion is not None:
        same = F.lower(strip(content)) == F.lower(strip(suggestion))
        note = F.when(same, F.lit("\nThe author took over the wording suggested earlier.")).otherwise("")
    return F.concat(
        F.lit("Decide whether this post is financial fraud.\nPost: "), content,
        F.lit("\nEarlier findings:\n"), seen, note,
        F.lit("\nHarmless talk about money is fine. Answer with one word, FRAUD or CLEAN."),
    )
