import re

from test_copies_and_shards import brute_groups
from test_tokens_and_packing import check_pieces

import corpus_pipeline
from modsieve.session import materialize, read_table

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def test_stages_by_brute_force(spark, small):
    docs = read_table(spark, small, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = materialize(stage(spark, docs, small), name)
        assert docs.columns == columns
        kept[name] = (before, docs.collect())
    before, after = kept["language_id"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if r["text"] and re.search(r"[^\W\d_]", r["text"])}
    before, after = kept["exact_dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        first.setdefault(BLANKS.sub(" ", r["text"]), r["doc_id"])
    assert {r["doc_id"] for r in after} == set(first.values()) and len(after) == len(first)
    before, after = kept["simhash"]
    ids = sorted(r["doc_id"] for r in before)
    text = {r["doc_id"]: r["text"] for r in before}
    names = brute_groups([text[i] for i in ids])
    assert sorted(r["doc_id"] for r in after) == [ids[k] for k in range(len(ids)) if names[k] == k]
    before, after = kept["mixing"]
    copies = {i: sum(r["doc_id"] == i for r in after) for i in {r["doc_id"] for r in before}}
    assert max(copies.values()) <= 2 and {r["doc_id"] for r in after} <= set(copies)
    pieces = [tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs.dropDuplicates(["doc_id"]), small).collect()]
    check_pieces({r["doc_id"]: r["text"] for r in docs.collect()}, pieces)


def test_run_and_odd_columns(spark, small, tmp_path):
    rows = [(1, "A fine post about the weather.", "en", "s", 30, "p", "c"), (2, None, None, None, None, None, None), (3, "A fine post about the weather.", "en", None, 30, "p", "c"), (4, "", "en", "s", 0, "p", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, post_id string, content string").write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} <= {1} and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_near_copies_by_shingles(spark, small):
    docs = read_table(spark, small, "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    names = brute_groups([text for _, text in rows])
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, small)
    assert sorted(r["doc_id"] for r in kept.collect()) == [rows[k][0] for k in range(len(rows)) if names[k] == k]
