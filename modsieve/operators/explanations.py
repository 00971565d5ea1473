"""Explanations for flagged posts: who needs one, what is asked, what the answer means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modsieve import constants as K

ANSWER = "explanation string, troublesome_words array<string>, suggestion string"


def explanation_prompt(content: Column) -> Column:
    return F.concat(
        F.lit("A post was held back.\nPost:\n"), content,
        F.lit(
            "\nSay in one or two plain sentences what is wrong with it, list the words that cause it and offer a"
            " friendlier wording. Answer with JSON only, fields explanation, troublesome_words, suggestion."
        ),
    )


def parse_explanation(response: Column, error: Column | None = None) -> Column:
    """From the first ``{`` to the last ``}`` as JSON; anything unreadable is passed on as plain text."""
    document = F.nullif(F.regexp_extract(response, r"(?s)\{.*\}", 0), F.lit(""))
    readable = F.try_parse_json(document).isNotNull()
    parsed = F.from_json(document, ANSWER)
    none = F.array().cast("array<string>")
    failure = F.lit(None).cast("string") if error is None else error

    def answer(explanation: Column, words: Column, suggestion: Column) -> Column:
        return F.struct(explanation.alias("explanation"), words.alias("troublesome_words"),
                        suggestion.alias("suggestion"))

    return (
        F.when(failure.isNotNull(), answer(failure, none, F.lit("")))
        .when(response.isNull(), answer(F.lit(K.EXPLANATION_FAILED), none, F.lit("")))
        .when(readable, answer(F.coalesce(parsed["explanation"], F.lit("")),
                               F.coalesce(parsed["troublesome_words"], none),
                               F.coalesce(parsed["suggestion"], F.lit(""))))
        .otherwise(answer(response, none, F.lit("")))
    )
