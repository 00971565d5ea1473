import datetime
import json

import pytest
from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.operators.lexicon import Lexicon
from modsieve.sources import keywords as KW
from modsieve.sources import posts as P
from modsieve.streaming import jobs as J

T0 = datetime.datetime(2024, 1, 1)


def test_csv_round_trip_and_refusals(spark, tmp_path):
    texts = ['say "hi", ok', "two\nlines", " blanks ", "élan 😅"]
    P.write_csv(spark.createDataFrame(list(enumerate(texts)), "id int, content string"), str(tmp_path / "x"))
    assert sorted(r.content for r in P.read_posts_csv(spark, str(tmp_path / "x")).collect()) == sorted(texts)
    with pytest.raises(ValueError):
        P.read_posts_csv(spark, "posts.xlsx")
    with pytest.raises(ValueError, match="Available columns"):
        P.validate_columns(spark.range(1), "content")
    with pytest.warns(UserWarning):
        assert P.validate_columns(spark.range(1), "id", "nope") is None


def test_bulk_ids(spark):
    df = spark.createDataFrame([(7, "a"), (9, " "), (11, None), (13, "b")], "n long, content string")
    assert {r.n: r.post_id for r in P.load_bulk(df, order="n").collect()} == {7: "post_1", 13: "post_2"}
    assert {r.post_id for r in P.load_bulk(df, id_column="n").collect()} == {"7", "13"}
    assert all(r.post_id.startswith("post_") for r in P.load_bulk(df).collect())


def test_every_row_gets_its_own_id(spark):
    df = spark.createDataFrame([("Hello!", 1.0), ("hello", 1.0), ("!!!", None), ("???", 1e300), ("Hello!", -5.0), ("Hello!", None)], "content string, n double")
    by_text = [r.post_id for r in P.assign_post_id(df).collect()]
    assert len(set(by_text)) == 6 and all(i.startswith("post_") for i in by_text)
    by_place = {r.post_id: r.n for r in P.assign_post_id(df, order="n").collect()}
    assert [by_place[f"post_{k}"] for k in range(1, 7)] == [None, None, -5.0, 1.0, 1.0, 1e300]


def test_keyword_files(spark, tmp_path):
    listed = spark.createDataFrame([(2, "Double Money"), (0, "***"), (1, "fraud")], "kw_idx int, keyword string")
    path = str(tmp_path / "deep" / "words")
    KW.lexicon_save(listed, path)
    rows = KW.lexicon_load(spark, path).orderBy("kw_idx").collect()
    assert [(r.kw_idx, r.keyword) for r in rows] == [(1, "fraud"), (2, "Double Money")]
    assert Lexicon.from_table(KW.lexicon_load(spark, path)).keywords == ("fraud", "Double Money")
    assert [r.keyword for r in KW.lexicon_load(spark, str(tmp_path / "none")).orderBy("kw_idx").collect()] == K.DEFAULT_RULE_KEYWORDS
    (tmp_path / "bad.json").write_text("{not json")
    bad = KW.lexicon_load(spark, str(tmp_path / "bad.json"), K.DEFAULT_FILE_KEYWORDS)
    assert [r.keyword for r in bad.orderBy("kw_idx").collect()] == K.DEFAULT_FILE_KEYWORDS


def test_rows_for_a_relational_table(spark):
    times = ["processing_time", *K.STAGE_TIME_COLUMN.values()]
    df = spark.range(1).select(F.array(F.lit("act now"), F.lit('a "b"')).alias("llm_troublesome_words"), *[F.lit(0.12345).alias(c) for c in times])
    flat = P.relational_rows(df)
    assert {flat.schema[c].dataType.simpleString() for c in times} == {"decimal(10,3)"}
    row = flat.first()
    assert json.loads(row.llm_troublesome_words) == ["act now", 'a "b"'] and str(row.processing_time) == "0.123"


def test_contract(spark):
    df = spark.createDataFrame([(1, "x", None)], "id int, content string, shade string")
    got = {r.column_name: (r.status, r.filled) for r in P.schema_contract(df, ["id", "content", "stage"]).collect()}
    assert got == {"id": ("ok", 1), "content": ("ok", 1), "shade": ("extra", 0), "stage": ("missing", 0)}
    assert not P.contract_holds(df) and P.contract_holds(df, ["id"])


def test_audit_lines_cut_content(spark):
    df = spark.createDataFrame([(1, "x" * 150, True, 0.5, T0)], "post_id int, content string, accepted boolean, processing_time double, created_at timestamp")
    asked, told = [json.loads(r.line) for r in P.audit_events(df.withColumn('comments', F.lit('c'))).orderBy("line_no").collect()]
    assert len(asked["content"]) == 100 and told["decision"] == "ACCEPTED" and asked["timestamp"] == "2024-01-01T00:00:00.000000Z"


def files(spark, path, rows, schema, parts):
    """One file per part, so that each becomes its own micro-batch."""
    df = spark.createDataFrame(rows, schema)
    for n in range(parts):
        df.filter(F.col("post_id") % parts == n).coalesce(1).write.mode("append").parquet(path)
    return df


def run(query):
    query.awaitTermination()
    assert query.exception() is None


@pytest.mark.parametrize("parts", [1, 4])
def test_streams_over_many_files_equal_batch(spark, tmp_path, parts):
    schema = "post_id long, stage string, threat_level string, band string, accepted boolean, created_at timestamp, processing_time double"
    rows = [(i, f"s{i % 3}", "low" if i % 4 else "high", f"b{i % 2}", bool(i % 4), T0 + datetime.timedelta(minutes=7 * i), i / 8) for i in range(400)]
    src = str(tmp_path / "in")
    df = files(spark, src, rows, schema, parts)
    stream = J.read_stream(spark, src, "*.parquet", df.schema, files_per_trigger=1)

    run(J.batch_sink(J.stream_running_totals(stream), J.versioned_writer(str(tmp_path / "a")), "complete", str(tmp_path / "ca")))
    got = {(r.stage, r.threat_level): (r.posts, r.accepted) for r in J.latest_per_key(spark, str(tmp_path / "a"), ["stage", "threat_level"]).collect()}
    want = {(r.stage, r.threat_level): (r.n, r.a) for r in df.groupBy("stage", "threat_level").agg(
        F.count("*").alias("n"), F.count_if("accepted").alias("a")).collect()}
    assert got == want

    run(J.batch_sink(J.stream_stage_stats(stream, late="30 days"), J.versioned_writer(str(tmp_path / "b")), "update", str(tmp_path / "cb")))
    state = J.latest_per_key(spark, str(tmp_path / "b"), ["window_start", "stage", "band"])
    assert state.agg(F.sum("posts"), F.sum("time_sum")).first()[:] == (400, sum(i / 8 for i in range(400)))


def test_stream_overrides_over_batches(spark, tmp_path):
    rows = [(i % 10, ["Accepted", "Rejected", "Flagged"][i % 3], T0 + datetime.timedelta(minutes=(i * 37) % 101), i) for i in range(100)]
    schema = "post_id long, override_value string, ts timestamp, seq long"
    df = files(spark, str(tmp_path / "in"), rows, schema, 5)
    stream = J.read_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema, files_per_trigger=1)
    run(J.batch_sink(stream, J.override_writer(str(tmp_path / "s")), "append", str(tmp_path / "c")))
    assert spark.read.parquet(str(tmp_path / "s")).select("batch").distinct().count() == 5
    got = {r.post_id: (r.override_value, r.seq) for r in J.current_overrides(spark, str(tmp_path / "s")).collect()}
    want = {}
    for post, value, ts, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        want[post] = (value, seq)
    assert got == want
    out = str(tmp_path / "s")

    def current():
        return {r.post_id: (r.override_value, r.seq) for r in J.current_overrides(spark, out).collect()}

    # stopped after every single step, at first without and then with an older snapshot
    for number in (4, 5, 6):
        for stop in range(1, 9):
            steps = J.compaction_steps(spark, out)
            done = [n for _, n in zip(range(stop), steps)]
            assert current() == want and set(done) <= {number}
            if len(done) < stop:
                break
            steps.close()
        assert J.override_log(spark, out).count() == 10
        J.override_writer(out)(spark.createDataFrame([(number, "Flagged", T0 + datetime.timedelta(days=number), 1_000)], schema), number + 1)
        want[number] = ("Flagged", 1_000)
        assert current() == want
    assert sorted(J._numbered(spark, out, "batch=")) == [7] and sorted(J._numbered(spark, J.snapshots(out), "upto=")) == [6]
    assert J.compact_overrides(spark, out) == 7 and current() == want
    assert J.compact_overrides(spark, str(tmp_path / "none")) == -1


def test_hours_are_corrected_and_late_rows_dropped(spark, tmp_path):
    def minute(n):
        return T0 + datetime.timedelta(minutes=n)

    src, schema, out = str(tmp_path / "in"), "post_id long, created_at timestamp", str(tmp_path / "out")
    batches = [[(0, minute(5)), (1, minute(50))], [(2, minute(65)), (3, minute(400))], [(4, minute(10)), (5, minute(410)), (6, minute(330))], [(7, minute(395))]]
    seen = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = J.read_stream(spark, src, "*.parquet", schema, files_per_trigger=1)
        run(J.batch_sink(J.stream_posts_per_hour(stream), J.versioned_writer(out), "update", str(tmp_path / "c")))
        seen.append({(r.hour, r.posts) for r in J.latest_per_key(spark, out, ["hour"]).collect()})
    assert seen[0] == {(T0, 2)}
    # an open hour is there at once, and corrected by what comes later
    assert seen[1] == {(T0, 2), (minute(60), 1), (minute(360), 1)}
    # the post at minute 10 came six hours late and is dropped; the one at minute 330 is in an hour that ends after 400 - 60
    assert seen[2] == {(T0, 2), (minute(60), 1), (minute(360), 2), (minute(300), 1)}
    assert seen[3] == {(T0, 2), (minute(60), 1), (minute(360), 3), (minute(300), 1)}


def test_stream_dedup_without_horizon(spark, tmp_path):
    schema, src = "post_id long, content string, created_at timestamp", str(tmp_path / "in")
    # half of all posts are one content; own contents come back 100 days and three batches later
    rows = [(i, "same, post" if i % 2 else f"own {i % 200}", T0 + datetime.timedelta(days=i // 2)) for i in range(800)]
    for k in range(4):
        spark.createDataFrame(rows[200 * k : 200 * k + 200], schema).repartition(2).write.mode("append").parquet(src)
    table = J.CopyTable(spark, str(tmp_path / "copies"), buckets=4)
    run(J.batch_sink(J.read_stream(spark, src, "*.parquet", schema, files_per_trigger=2), table.write, "append", str(tmp_path / "c")))
    found = {r.post_id: r.batch for r in table.rows().collect()}
    assert found == {1: 0} | {i: 0 for i in range(0, 200, 2)}
    # replaying a batch changes nothing, the first one included; a later batch meets a table opened anew
    for k in (0, 2):
        table.write(spark.createDataFrame(rows[200 * k : 200 * k + 200], schema), k)
    assert {r.post_id: r.batch for r in table.rows().collect()} == found
    table.close()
    again = J.CopyTable(spark, str(tmp_path / "copies"), buckets=4)
    again.write(spark.createDataFrame([(900, "OWN 4!", T0), (901, "new", T0), (902, "New", T0), (903, None, T0)], schema), 4)
    assert {r.post_id for r in again.rows().filter("batch = 4").collect()} == {901, 903}
    seen = again.rows().filter("batch < 9").select("copy")
    plan = again.rows().select("copy").join(seen.hint("merge"), "copy", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    again.close()


def test_stream_moderate_over_a_folder_of_files(spark, small, tmp_path):
    import __spark_entry__ as entry

    spark.read.parquet(f"{small}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "labels.parquet").symlink_to(f"{small}/labels.parquet")
    run = entry.queries()["stream_moderate"]
    want = sorted(map(str, run(spark, small).collect()))
    assert want and sorted(map(str, run(spark, str(tmp_path)).collect())) == want
