"""Moderate a table of posts: contents in, decisions, records and explanation requests out.

A content is read once, in the projection that runs the rules and everything else that needs it.  Decisions are made on
narrow rows, and a content meets a join again only where the output has to hold it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.functions.labels import needs_explanation
from modsieve.functions.text import iso_time, snippet
from modsieve.operators.cascade import TIME_COLUMNS, Cascade, analysis_columns, decision_columns, stage_timings
from modsieve.operators.explanations import explanation_prompt
from modsieve.operators.lexicon import Lexicon
from modsieve.operators.providers import score_table
from modsieve.operators.reports import analysis_report
from modsieve.operators.stages import Stage, classifier_stage, rules_stage, sentiment_stage, toxicity_stage, verdict_stage, with_verdict
from modsieve.session import materialize
from modsieve.sources.posts import load_bulk, read_posts_csv

#: What the default stages read besides the content, and the type a missing provider leaves.
SCORES = {
    "class_probs": "array<double>", "sentiment": "struct<label:string,score:double,error:string>", "verdict_response": "string",
}
SNIPPET = 200


def from_column(column: str, name: str) -> Stage:
    """A stage whose result is already a column."""
    return Stage(name, lambda posts, earlier: F.col(column))


def default_cascade(lexicon: Lexicon | None = None) -> Cascade:
    return Cascade([rules_stage(lexicon), classifier_stage(), toxicity_stage(), sentiment_stage(), verdict_stage()])


def decide(posts: DataFrame, toxicity: DataFrame, lexicon: Lexicon | None = None,
           text_scores: Callable[[DataFrame], DataFrame] | None = None, keep_content: bool = False) -> DataFrame:
    """``post_id``, ``n_executed``, ``trace`` and ``outcome`` of every post (``post_id``, ``content``) in the default cascade.

    ``text_scores`` appends the columns of :data:`SCORES` it has a provider for, from the content; ``toxicity`` is a
    table of scores by ``post_id``.  Only a caller that asks for it gets the content back, and pays for its way
    through the join with the scores.
    """
    rules = rules_stage(lexicon)
    scored = rules.prepare(posts)
    if text_scores is not None:
        scored = text_scores(scored)
    for column, kind in SCORES.items():
        if column not in scored.columns:
            scored = scored.withColumn(column, F.lit(None).cast(kind))
    # an answer may be as long as the post: only its verdict goes through the join
    ready = with_verdict(scored.withColumn("_rules", rules.decide(scored, [])))
    own = ["post_id", *(["content"] if keep_content else [])]
    joined = score_table(ready.select(*own, "class_probs", "sentiment", "_verdict", "_rules"), toxicity, "toxicity")
    stages = Cascade([from_column("_rules", K.STAGE_RULES), classifier_stage(), toxicity_stage(), sentiment_stage(), verdict_stage(None)])
    return stages.run(joined).select(*own, "n_executed", "trace", "outcome")


def explanation_requests(posts: DataFrame, decided: DataFrame) -> DataFrame:
    """``post_id``, ``action`` and ``prompt`` of the posts that need an explanation.

    The narrow decisions are filtered first; only contents of their posts get a prompt.
    """
    flagged = decision_columns(decided, "post_id").filter(needs_explanation(F.col("action"))).select("post_id", "action")
    return posts.select("post_id", "content").join(flagged, "post_id").select("post_id", "action", explanation_prompt(F.col("content")).alias("prompt"))


def posts_rows(decided: DataFrame, seconds: Mapping[str, Column] | None = None, answer: Column | None = None, created_at: Column | None = None) -> DataFrame:
    """Complete rows of the posts table from :func:`decide`'s result (with ``content``, if it is to be in the rows).

    ``seconds`` has the measured time of each stage by its timing column, zeroed where the stage did not run; ``answer`` is a parsed explanation, taken for flagged posts
    only; without ``created_at`` rows are of now.  A new row is not overridden and has no comment.
    """
    kept = [c for c in ("content",) if c in decided.columns]
    flat = decision_columns(decided, "post_id", *kept, "n_executed")
    seconds = {column: F.lit(0.0) for column in TIME_COLUMNS} | dict(seconds or {})
    none = F.lit(None).cast("struct<explanation:string,troublesome_words:array<string>,suggestion:string>")
    told = F.when(needs_explanation(F.col("action")), none if answer is None else answer)
    timed = stage_timings(flat.withColumns(seconds).withColumn("_answer", told))
    return timed.withColumns({
        "created_at": F.current_timestamp() if created_at is None else created_at,
        "processing_time": functools.reduce(lambda total, column: total + F.col(column), TIME_COLUMNS, F.lit(0.0)),
        "override": F.lit("No"),
        "llm_explanation": F.coalesce(F.col("_answer")["explanation"], F.lit("")),
        "llm_troublesome_words": F.coalesce(F.col("_answer")["troublesome_words"], F.array().cast("array<string>")),
        "llm_suggestion": F.coalesce(F.col("_answer")["suggestion"], F.lit("")),
        "comments": F.lit(None).cast("string"),
    }).drop("_answer")


def analyse_csv(spark: SparkSession, path: str, analysed_at: Column, content: str = "content", id_column: str | None = None,
                toxicity: DataFrame | None = None, lexicon: Lexicon | None = None, text_scores: Callable[[DataFrame], DataFrame] | None = None,
                seconds: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """From CSV files to records and their report: read, check, skip empty posts, number, decide, record, sum up.

    Without an id column posts are numbered by their place in the files, which moves no content.  The records are written once; the
    report reads what was written.
    """
    loaded = load_bulk(read_posts_csv(spark, path), content, id_column, position=True)
    posts = loaded.select("post_id", F.col(content).alias("content"))
    scores = toxicity if toxicity is not None else spark.createDataFrame([], "post_id string, label string, score double, error string")
    rows = posts_rows(decide(posts, scores, lexicon, text_scores, keep_content=True), seconds, created_at=analysed_at.cast("timestamp"))
    record = analysis_record(rows.withColumn("error", F.lit(None).cast("string")), analysed_at)
    written = materialize(record, "analysis_records")
    return written, analysis_report(written)


def analysis_record(rows: DataFrame, analysed_at: Column, error: str = "error") -> DataFrame:
    """The bulk analyser's record, all 17 columns; ``rows`` are decisions with ``content``, ``created_at`` and ``processing_time``."""
    record = analysis_columns(rows, "post_id", "content", "created_at", "processing_time", error=error)
    return record.select(
        "post_id", snippet(F.col("content"), SNIPPET).alias("content"), F.col("content").alias("full_content"),
        iso_time(F.col("created_at")).alias("timestamp"), "processing_time", "final_status", "band", "action", "threat_level", "confidence",
        "stage", "decision_model", "reason", "escalated", "accepted", "error", analysed_at.alias("analysis_timestamp"))
