"""Manual review: overrides and comments are append-only commands resolved by join at read time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.functions.labels import accepted_of, action_of, review_label


def latest_command(commands: DataFrame, *values: str) -> DataFrame:
    """The last command per post by ``(ts, seq)``.

    An aggregate, not a window: a post that is commented on a billion times is reduced in every
    map task before anything is shuffled.
    """
    newest = F.max(F.struct("ts", "seq", *values)).alias("_newest")
    return commands.groupBy("post_id").agg(newest).select("post_id", *[F.col("_newest")[v].alias(v) for v in ("ts", "seq", *values)])


def override_rejects(commands: DataFrame) -> DataFrame:
    """Commands whose value is not one of the three known ones."""
    return commands.filter(F.col("override_value").isNull() | ~F.col("override_value").isin(*K.OVERRIDE_VALUES))


def valid_overrides(commands: DataFrame) -> DataFrame:
    return commands.filter(F.col("override_value").isin(*K.OVERRIDE_VALUES))


def override_apply(posts: DataFrame, commands: DataFrame) -> DataFrame:
    """Posts with the last valid override applied; only override, accepted and action change.

    ``decision`` is the engine's own decision and never changes, however often a post is overridden.  Choosing the
    label it had takes the override back, with the accepted and action it had; any other value is marked ``Yes``.
    Rows stored without a decision get it from the cascade first (:func:`restore_decision`).
    """
    if "decision" not in posts.columns:
        raise ValueError("override_apply needs the engine's own decision in a column `decision`")
    newest = latest_command(valid_overrides(commands), "override_value").select("post_id", "override_value")
    accepted, action = accepted_of(F.col("decision")), action_of(F.col("decision"))
    value = F.col("override_value")
    told = value.isNotNull()
    changed = told & (value != review_label(accepted, action))
    joined = posts.join(newest, "post_id", "left")
    return joined.withColumns({
        "override": F.when(changed, "Yes").when(told, "No").otherwise(F.coalesce("override", F.lit("No"))),
        "accepted": F.when(changed, value == "Accepted").when(told, accepted).otherwise(F.col("accepted")),
        "action": F.when(changed & (value == "Accepted"), "PASS").when(changed & (value == "Rejected"), "BLOCK")
        .when(changed, "FLAG_MEDIUM").when(told, action).otherwise(F.col("action")),
    }).select(*posts.columns)


def restore_decision(posts: DataFrame, decided: DataFrame) -> DataFrame:
    """Stored posts with the decision of a new run of the cascade over their contents (``post_id, decision``)."""
    return posts.drop("decision").join(decided.select("post_id", "decision"), "post_id", "left")


def not_found(commands: DataFrame, posts: DataFrame) -> DataFrame:
    """Commands for posts that do not exist."""
    return commands.join(posts.select("post_id"), "post_id", "left_anti")


def comment_rejects(commands: DataFrame) -> DataFrame:
    return commands.filter(F.length("comments") > K.COMMENT_MAX_CHARS)


def comments_apply(posts: DataFrame, commands: DataFrame) -> DataFrame:
    """Posts with the last comment that fits the column."""
    fitting = commands.filter(F.col("comments").isNull() | (F.length("comments") <= K.COMMENT_MAX_CHARS))
    newest = latest_command(fitting, "comments").select(
        "post_id", F.col("comments").alias("_new"), F.lit(True).alias("_said"))
    joined = posts.join(newest, "post_id", "left")
    return joined.withColumn(
        "comments", F.when(F.col("_said"), F.col("_new")).otherwise(F.col("comments"))).select(*posts.columns)


def reviewed_only(posts: DataFrame, commands: DataFrame) -> DataFrame:
    return posts.join(commands.select("post_id"), "post_id", "left_semi")


def unreviewed(posts: DataFrame, commands: DataFrame) -> DataFrame:
    return posts.join(commands.select("post_id"), "post_id", "left_anti")


def posts_listing(posts: DataFrame) -> DataFrame:
    """All posts, newest first, with defaults for legacy nulls; ties broken by id."""
    return posts.select(
        F.col("post_id").alias("id"), "content", "accepted", "reason", "threat_level",
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "stage",
        F.coalesce("band", F.lit("SAFE")).alias("band"),
        F.coalesce("action", F.lit("PASS")).alias("action"),
        F.coalesce("processing_time", F.lit(0.0)).alias("processing_time"),
        F.coalesce("override", F.lit("No")).alias("override"),
        "llm_explanation",
        F.coalesce("llm_troublesome_words", F.array().cast("array<string>")).alias("llm_troublesome_words"),
        "llm_suggestion", "created_at",
    ).orderBy(F.desc("created_at"), F.desc("id"))


def post_by_id(posts: DataFrame, post_id: int) -> DataFrame:
    """One post; the equality reaches the scan, where row-group statistics skip the rest."""
    return posts.filter(F.col("post_id") == post_id)


def posts_by_request(posts: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per lookup request; ``requests`` holds ``request_id, post_id``."""
    return requests.join(posts, "post_id")
