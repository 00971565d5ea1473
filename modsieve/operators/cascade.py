"""Ordered stages, first BLOCK wins; the whole cascade is one projection over the posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.functions import labels as L
from modsieve.operators.rows import expand_with_position
from modsieve.operators.stages import RESULT_TYPE, Stage, result

TIME_COLUMNS = list(K.STAGE_TIME_COLUMN.values())


class Cascade:
    """A list of stages in execution order.

    ``run`` appends

    * ``trace``: results of the stages up to and including the first BLOCK, in order,
    * ``outcome``: the result that counts, i.e. the last element of the trace,
    * ``n_executed``: how many stages ran.
    """

    def __init__(self, stages: list[Stage] | tuple[Stage, ...] = ()):
        self.stages = list(stages)

    def register(self, stage: Stage) -> "Cascade":
        return Cascade([*self.stages, stage])

    def names(self) -> list[str]:
        return [stage.name for stage in self.stages]

    def run(self, posts: DataFrame) -> DataFrame:
        own = posts.columns
        wide = posts
        columns: list[str] = []
        for number, stage in enumerate(self.stages):
            if stage.prepare is not None:
                wide = stage.prepare(wide)
            column = f"_stage_{number}"
            wide = wide.withColumn(column, stage.decide(wide, [F.col(c) for c in columns]))
            columns.append(column)
        wide = wide.withColumn("n_executed", _executed([F.col(c) for c in columns]))
        trace = F.slice(F.array(*columns), 1, F.col("n_executed")) if columns else F.array().cast(f"array<{RESULT_TYPE}>")
        wide = wide.withColumn("trace", trace)
        nothing = result("ACCEPT", K.STAGE_EMPTY, "all_stages_passed", 1.0, "low")
        wide = wide.withColumn("outcome", F.coalesce(F.try_element_at("trace", F.lit(-1)), nothing))
        return wide.select(*own, "n_executed", "trace", "outcome")


def _executed(results: list[Column]) -> Column:
    if not results:
        return F.lit(0)
    out = None
    for number, step in enumerate(results, start=1):
        blocked = step["decision"] == "BLOCK"
        out = F.when(blocked, number) if out is None else out.when(blocked, number)
    return out.otherwise(len(results))


def resolve(trace: Column) -> Column:
    """The same rule for a stored array of results: first BLOCK, else the last one, else accept."""
    nothing = result("ACCEPT", K.STAGE_EMPTY, "all_stages_passed", 1.0, "low")
    blocks = F.filter(trace, lambda s: s["decision"] == "BLOCK")
    return F.coalesce(F.get(blocks, F.lit(0)), F.try_element_at(trace, F.lit(-1)), nothing)


def decision_columns(decided: DataFrame, *keep: str) -> DataFrame:
    """Flatten the outcome and derive accepted, action and band."""
    out = F.col("outcome")
    return decided.select(
        *keep,
        out["decision"].alias("decision"),
        L.accepted_of(out["decision"]).alias("accepted"),
        out["reason"].alias("reason"),
        out["threat_level"].alias("threat_level"),
        out["confidence"].alias("confidence"),
        out["stage"].alias("stage"),
        L.band_of(out["threat_level"]).alias("band"),
        L.action_of(out["decision"]).alias("action"),
    )


def stage_trace(decided: DataFrame, *keep: str) -> DataFrame:
    """One row per post and executed stage."""
    steps = expand_with_position(decided, "trace", "position", "step", *keep)
    return steps.select(
        *keep,
        (F.col("position") + 1).alias("position"),
        *[F.col("step")[name].alias(name) for name in ("stage", "decision", "reason", "confidence", "threat_level")],
    )


def stage_timings(decided: DataFrame) -> DataFrame:
    """Zero the timing columns of stages that did not run; timings are input data, in stage order."""
    return decided.withColumns({
        column: F.when(F.col("n_executed") >= number, F.col(column)).otherwise(0.0)
        for number, column in enumerate(TIME_COLUMNS, start=1)
    })


def result_record(outcome: Column) -> Column:
    """A result as a JSON document."""
    return F.to_json(outcome)


def error_outcome(error: Column) -> Column:
    """What a failed analysis puts in place of a decision."""
    return F.struct(
        F.lit("Error").alias("final_status"),
        F.lit("ERROR").alias("band"),
        F.lit("ERROR").alias("action"),
        F.lit("unknown").alias("threat_level"),
        F.lit(0.0).alias("confidence"),
        F.lit(K.STAGE_ERROR).alias("stage"),
        F.lit("Error").alias("decision_model"),
        F.concat(F.lit("Analysis failed: "), error).alias("reason"),
        F.lit(False).alias("escalated"),
        F.lit(False).alias("accepted"),
    )


def analysis_columns(decided: DataFrame, *keep: str, error: str = "error") -> DataFrame:
    """Decision table of the bulk analyzer: a failed row becomes an ERROR row instead of stopping the job."""
    good = F.struct(
        L.status_of(F.col("band")).alias("final_status"),
        F.col("band").alias("band"),
        F.col("action").alias("action"),
        F.col("threat_level").alias("threat_level"),
        F.col("confidence").alias("confidence"),
        F.col("stage").alias("stage"),
        L.model_of(F.col("stage")).alias("decision_model"),
        F.col("reason").alias("reason"),
        L.is_escalated(F.col("threat_level"), F.col("confidence"), F.col("stage"), F.col("action")).alias("escalated"),
        F.col("accepted").alias("accepted"),
    )
    failed = F.col(error)
    picked = decided.select(
        *keep, failed.alias("error"), F.when(failed.isNotNull(), error_outcome(failed)).otherwise(good).alias("_row"))
    return picked.select(*keep, "_row.*", "error")


def is_external_failure(error: Column) -> Column:
    text = F.lower(error)
    out = F.lit(False)
    for word in K.EXTERNAL_FAILURE_WORDS:
        out = out | text.contains(word)
    return out


def external_failure_fallback(failures: DataFrame, *keep: str, error: str = "error") -> DataFrame:
    """Failures of outside services become an accepted fallback row; all others are quarantined."""
    outside = is_external_failure(F.col(error))
    return failures.select(
        *keep,
        F.when(outside, "fallback").otherwise("quarantine").alias("route"),
        F.when(outside, F.lit(True)).alias("accepted"),
        F.when(outside, F.lit(K.FALLBACK_REASON)).otherwise(F.col(error)).alias("reason"),
        F.when(outside, F.lit("low")).alias("threat_level"),
        F.when(outside, F.lit(0.5)).alias("confidence"),
        F.when(outside, F.lit(K.STAGE_FALLBACK)).alias("stage"),
        F.when(outside, F.lit("SAFE")).alias("band"),
        F.when(outside, F.lit("PASS")).alias("action"),
        F.when(outside, F.lit(K.FALLBACK_EXPLANATION)).alias("explanation"),
    )


def model_status(cascade: Cascade, trace: DataFrame) -> DataFrame:
    """All registered stages in order, with how many posts each one saw, 0 if none reached it."""
    names = cascade.names()
    schema = "stage_number int, stage string, pipeline_stages int"
    registered = trace.sparkSession.createDataFrame([(k, n, len(names)) for k, n in enumerate(names, start=1)], schema)
    seen = trace.groupBy("stage").agg(F.count("*").alias("posts"))
    return registered.join(seen, "stage", "left").select(
        "stage_number", "stage", F.coalesce("posts", F.lit(0)).cast("long").alias("posts"), "pipeline_stages")
