"""Reading and writing posts, decisions, training rows and logs."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.functions.text import is_blank, iso_time
from modsieve.operators.ranking import ranked
from modsieve.session import materialize

CSV_CELLS = {
    "header": True, "quote": '"', "escape": '"', "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,  # cells are kept as they are
}
CSV_OPTIONS = {**CSV_CELLS, "multiLine": True}

POSTS_SCHEMA = (
    "id bigint, content string, accepted boolean, reason string, threat_level string, confidence double, "
    "stage string, band string, action string, created_at timestamp, processing_time double, "
    "rulebased_time double, lgbm_time double, detoxify_time double, finbert_time double, llm_time double, "
    "override string, llm_explanation string, llm_troublesome_words array<string>, llm_suggestion string, "
    "comments string"
)


def read_posts_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Posts from CSV files with a header; quoted cells may span lines.

    A quoted line break makes a file unsplittable, so feed many medium files rather than one huge
    one.  Without a schema all columns are strings: no extra pass to infer types.
    """
    suffix = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in suffix and not suffix.lower().endswith(".csv"):
        raise ValueError(f"unsupported file format: {suffix}; only .csv files or a folder of them")
    reader = spark.read.options(**CSV_OPTIONS)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(**CSV_CELLS, quoteAll=True).csv(path)


def validate_columns(posts: DataFrame, content: str = "content", id_column: str | None = None) -> str | None:
    """Stop before any job when the content column is missing; drop a missing id column with a warning.

    Returns the id column to use, or None for generated ids.
    """
    if content not in posts.columns:
        raise ValueError(f"Content column '{content}' not found. Available columns: {posts.columns}")
    if id_column and id_column not in posts.columns:
        warnings.warn(f"ID column '{id_column}' not found, generating ids", stacklevel=2)
        return None
    return id_column


def skip_empty(posts: DataFrame, content: str = "content") -> DataFrame:
    """Drop rows without visible text; a missing cell has no text either."""
    return posts.filter(F.col(content).isNotNull() & ~is_blank(F.col(content)))


def number_by_position(posts: DataFrame, name: str) -> DataFrame:
    """Append gapless numbers from 1: files by their paths, rows as they stand in a file.  ``posts`` is read from files.

    Only counts move: the rows of every split are counted first, running sums give each split its first number, and a row's number is that plus
    its place in the split.  Both passes read the same splits, as they do while files and settings stay the same.
    """
    split = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    placed = posts.select("*", *split, F.monotonically_increasing_id().alias("_place"))
    paths = posts.select(F.col("_metadata.file_path").alias("_path"), *split, F.monotonically_increasing_id().alias("_place"))
    counts = materialize(paths.groupBy("_path", "_file", "_block").agg(F.count("*").alias("n"), F.min("_place").alias("_first")), "splits")
    before = Window.partitionBy().orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", "_block", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    # one row of four numbers for every split of the files
    joined = placed.join(F.broadcast(starts), ["_file", "_block"])
    return joined.select(*posts.columns, (F.col("_start") + F.col("_place") - F.col("_first") + 1).alias(name))


def assign_post_id(posts: DataFrame, id_column: str | None = None, order: str | None = None,
                   content: str = "content", position: bool = False) -> DataFrame:
    """Append ``post_id``: the id column as text, else ``post_<n>`` by the place in the source files (``position``) or by ``order``, else by
    the order of contents.

    Every row gets an id of its own: rows of one position, or of one content, are numbered one after the other, and
    null positions come first.  By position no content moves; the two other ways sort rows, without a global single-task sort.
    """
    if id_column:
        return posts.withColumn("post_id", F.col(id_column).cast("string"))
    if position:
        numbered = number_by_position(posts, "_n")
        return numbered.withColumn("post_id", F.concat(F.lit("post_"), F.col("_n").cast("string"))).drop("_n")
    if order:
        return ranked(posts, order, name="_n").withColumn("post_id", F.concat(F.lit("post_"), F.col("_n").cast("string"))).drop("_n")
    # copies of one content share its digest and differ by their number among the copies
    marked = posts.withColumn("_key", F.sha2(F.coalesce(content, F.lit("")), 256)).withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    numbered = ranked(marked, "_tie", ["_key"], name="_n")
    return numbered.withColumn("post_id", F.concat(F.lit("post_"), "_key", F.lit("_"), F.col("_n").cast("string"))).drop("_key", "_tie", "_n")


def load_bulk(posts: DataFrame, content: str = "content", id_column: str | None = None,
              order: str | None = None, position: bool = False) -> DataFrame:
    """Check columns, skip empty posts, give every post an id."""
    use = validate_columns(posts, content, id_column)
    return assign_post_id(skip_empty(posts, content), use, order, content, position)


def store_posts(rows: DataFrame, table: str, location: str, buckets: int, key: str = "post_id") -> DataFrame:
    """Write a table bucketed and sorted by ``key`` and return it.

    Tables with the same buckets meet on the key without moving a row: posts stored once beside their scores and decisions cost no
    shuffle of contents in moderation, prompts, explanation requests and listings.
    """
    spark = rows.sparkSession
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", location).saveAsTable(table)
    return spark.table(table)


def posts_append(rows: DataFrame, path: str) -> None:
    """Append decision rows, one folder per creation day so that day filters skip files.

    Rebalancing gives each day few files of even size, and splits a day that holds most rows.
    """
    dated = rows.withColumn("created_date", F.to_date("created_at"))
    dated.hint("rebalance", "created_date").write.mode("append").partitionBy("created_date").parquet(path)


def relational_rows(rows: DataFrame) -> DataFrame:
    """Posts as a relational table takes them: lists as JSON text, times as DECIMAL(10,3)."""
    return ddl_view(rows.withColumn("llm_troublesome_words", F.to_json("llm_troublesome_words")))


def posts_append_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Append to a relational posts table."""
    relational_rows(rows).write.mode("append").jdbc(url, table, properties=properties)


def posts_legacy_load(raw: DataFrame) -> DataFrame:
    """A posts table with numbers and lists stored as text, typed; unreadable cells become defaults."""

    def number(name: str, default: float):
        return F.coalesce(F.col(name).try_cast("double"), F.lit(default)).alias(name)

    words = F.from_json(F.when(F.col("llm_troublesome_words") != "", F.col("llm_troublesome_words")), "array<string>")
    return raw.select(
        "id", "content", "accepted", "reason", "threat_level", number("confidence", 1.0), "stage",
        F.coalesce("band", F.lit("SAFE")).alias("band"), F.coalesce("action", F.lit("PASS")).alias("action"),
        "created_at", number("processing_time", 0.0),
        *[number(c, 0.0) for c in K.STAGE_TIME_COLUMN.values()],
        F.coalesce("override", F.lit("No")).alias("override"),
        "llm_explanation", F.coalesce(words, F.array().cast("array<string>")).alias("llm_troublesome_words"),
        "llm_suggestion", "comments",
    )


def ddl_view(posts: DataFrame) -> DataFrame:
    """Times as DECIMAL(10,3), as the relational schema declares them."""
    times = ["processing_time", *K.STAGE_TIME_COLUMN.values()]
    return posts.withColumns({c: F.col(c).cast("decimal(10,3)") for c in times})


def schema_contract(posts: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """One row per expected or extra column: its status and how many rows hold a value.

    Only names decide the status; a missing column makes the table invalid, an extra one does not.
    One scan for all counts.
    """
    wanted = K.POSTS_CONTRACT if expected is None else expected
    present = [c for c in wanted if c in posts.columns]
    extra = [c for c in posts.columns if c not in wanted]
    status = {**{c: "ok" for c in present}, **{c: "extra" for c in extra}}
    counts = posts.agg(*[F.count(c).alias(c) for c in [*present, *extra]])
    found = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(s).alias("status"), F.col(c).alias("filled"))
        for c, s in status.items()])
    missing = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit("missing").alias("status"), F.lit(0).cast("long").alias("filled"))
        for c in wanted if c not in posts.columns])
    both = F.concat(found, missing) if len(present) < len(wanted) else found
    return counts.select(F.explode(both).alias("c")).select("c.*")


def contract_holds(posts: DataFrame, expected: list[str] | None = None) -> bool:
    return all(c in posts.columns for c in (K.POSTS_CONTRACT if expected is None else expected))


def column_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Names only on one side, by set difference over two ``column_name`` frames."""
    return (
        expected.exceptAll(actual).withColumn("status", F.lit("missing"))
        .unionByName(actual.exceptAll(expected).withColumn("status", F.lit("extra")))
    )


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows for further analysis."""
    rows.write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON documents, one per row."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_train_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**CSV_OPTIONS).schema("text string, label string").csv(path)


def audit_events(posts: DataFrame, module: str = "main") -> DataFrame:
    """Log lines of one decision: the request, then what was decided."""
    when = F.concat(iso_time(F.col("created_at")), F.lit("Z"))
    head = [when.alias("timestamp"), F.lit("INFO").alias("level"), F.lit(module).alias("module")]
    asked = F.to_json(F.struct(*head, F.lit("Incoming moderation request").alias("message"),
                               F.substring("content", 1, 100).alias("content"), F.col("comments").alias("comments")))
    told = F.to_json(F.struct(*head, F.lit("Moderation decision").alias("message"),
                              F.col("post_id").alias("content_id"),
                              F.when(F.col("accepted"), "ACCEPTED").otherwise("REJECTED").alias("decision"),
                              F.col("processing_time").alias("processing_time")))
    return posts.select("post_id", F.posexplode(F.array(asked, told)).alias("line_no", "line"))


def audit_comments(comments: DataFrame, module: str = "main") -> DataFrame:
    """Log lines of comments that were saved."""
    when = F.concat(iso_time(F.col("ts")), F.lit("Z"))
    line = F.to_json(F.struct(
        when.alias("timestamp"), F.lit("INFO").alias("level"), F.lit(module).alias("module"),
        F.lit("Comments updated").alias("message"), F.col("post_id").alias("content_id"), F.col("comments").alias("comments")))
    return comments.select("post_id", line.alias("line"))


def audit_commands(overrides: DataFrame, module: str = "main") -> DataFrame:
    """Log lines of manual overrides joined to the label before them."""
    when = F.concat(iso_time(F.col("ts")), F.lit("Z"))
    line = F.to_json(F.struct(
        when.alias("timestamp"), F.lit("INFO").alias("level"), F.lit(module).alias("module"),
        F.lit("Manual override").alias("message"), F.col("post_id").alias("content_id"),
        F.col("original_label").alias("original_decision"), F.col("override_value").alias("overridden_decision")))
    return overrides.select("post_id", line.alias("line"))
