"""Small tables of posts with everything that may go wrong in one."""

from __future__ import annotations

POSTS = "post_id long, content string, category string, language string, toxic int, _words string, kept string, size string, digest string"

EDGES = [
    (1, "Plain text, twice the same. Plain text, twice the same.", "PASS", "en", 0),
    (1, "Plain text, twice the same. Plain text, twice the same.", "PASS", "en", 0),
    (2, None, "PASS", None, None),
    (3, "", None, "en", 0),
    (4, " \t\n ", "FLAG", "de", 1),
    (None, "No id at all.", "FLAG", "en", 1),
    (5, "word " * 30_000, "BLOCK", "en", 0),
    (6, "x" * 50_000, "BLOCK", "en", 0),
    (7, "Ünïcödé 漢字 🙂🏽 é ﬁ İ ΑΣ", "PASS", "fr", 0),
    (8, "<|endoftext|> it's <s>[INST] ok [/INST]</s> \\ <\\/s>", None, None, 1),
    (9, "12 34 !?", "PASS", "fr", 0),
]


def edge_posts(spark):
    rows = [(*r, "own", "own", "own", "own") for r in EDGES]
    return spark.createDataFrame(rows, POSTS)


def no_posts(spark):
    return spark.createDataFrame([], POSTS)
