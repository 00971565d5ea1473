import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F
from tables import edge_posts, no_posts

from modsieve.llm import chat, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated(words):
    grams = list(zip(words, words[1:], words[2:]))
    counts = Counter(grams)
    return len({k + d for k, g in enumerate(grams) if counts[g] > 1 for d in range(3)})


def test_repeat_words_by_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["a " * 3000]
    frame = spark.createDataFrame(list(enumerate(texts)), "post_id long, content string")
    want = {k: repeated(WORD.findall(t)) for k, t in enumerate(texts)}
    assert {r["post_id"]: r["n_repeat_words"] for r in quality.clean_lines(frame).collect()} == want
    # texts too long for packed places take the same words another way
    monkeypatch.setattr(quality, "PLACE_BITS", 3)
    assert {r["post_id"]: r["n_repeat_words"] for r in quality.clean_lines(frame).collect()} == want


def test_lines(spark):
    body = "\n".join("Line " + " ".join(f"word{k}{j}" for j in range(10)) + " ends." for k in range(8))
    cases = [
        (1, body), (2, f"{body}\nAll rights reserved.\nHome | News | Sport | Contact"), (3, "\n".join(["Home | News | Sport | Contact us | More"] * 12)),
        (5, "\n".join("Line " + " ".join(f"word{k}{j}%%%" for j in range(10)) + " ends." for k in range(8))),
        (4, "\n".join(f"no sentence mark in line {k} of this list here" for k in range(12))),
    ]
    rows = {r["post_id"]: r for r in quality.clean_lines(spark.createDataFrame(cases, "post_id long, content string")).collect()}
    assert [rows[k]["kept"] for k in (1, 2, 3, 4, 5)] == [True, True, False, False, False]
    assert rows[2]["cleaned"] == body and rows[1]["n_lost_chars"] == 0 and rows[4]["n_lost_chars"] == rows[4]["word_chars"]


def test_quality_edge_posts(spark):
    cleaned = quality.clean_lines(edge_posts(spark))
    assert cleaned.columns.count("kept") == 1 and {"_words", "size", "digest"} <= set(cleaned.columns)
    rows = cleaned.collect()
    assert len(rows) == 11 and {r["_words"] for r in rows} == {"own"}
    for row in rows:
        words = WORD.findall(row["content"] or "")
        assert (row["n_words"], row["word_chars"], row["n_repeat_words"]) == (len(words), sum(map(len, words)), repeated(words))
        assert isinstance(row["kept"], bool) and isinstance(row["base_failed"], bool)
    assert quality.clean_lines(no_posts(spark)).count() == 0


def test_no_python_in_native_plans(spark, small):
    from modsieve.llm.queries import op2_quality_rules, op4_chat_formatting

    for query in (op2_quality_rules, op4_chat_formatting):
        plan = query(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{c}\n" for r, c in turns).encode()).hexdigest()


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(6)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", " [/INST]", "<\\s>", "[\\\\/INST]", "\\", "<", "[", "/", "s>", "x", " ", "\n", "é🙂", ""]
    rows, want = [], {}
    for post in range(150):
        turns = []
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "odd [/INST] role", "</s>"])
            content = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
            rows.append((post, turn, role, content))
            turns.append((role, content))
        want[post] = turns
    out = chat.render_exchanges(spark.createDataFrame(rows, "post_id long, turn long, role string, content string"))
    out = out.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).withColumn("sha", chat.digest_turns(F.col("turns"))).collect()
    assert len(out) == len(want)
    for row in out:
        turns = want[row["post_id"]]
        assert row["identical"] and [(t["role"], t["content"]) for t in row["turns"]] == turns and row["sha"] == digest(turns)
        assert row["loss"] == "".join(c for r, c in turns if r == "assistant")
        assert [row["formatted"][s["start"] : s["start"] + s["length"]] for s in row["loss_spans"]] == [t["raw"] for t in row["turns"] if t["role"] == "assistant"]


def test_exchange_edge_rows(spark):
    schema = "post_id long, turn long, role string, content string, formatted string, source string"
    rows = [(1, None, None, None, "x", "y"), (1, 0, "user", None, "x", "y"), (1, 0, "user", "b", "x", "y"), (1, 0, "user", "b", "x", "y"), (None, 1, "assistant", "[INST]", "x", "y"), (2, 0, "assistant", "", "x", "y")]
    out = {r["post_id"]: r for r in chat.render_exchanges(spark.createDataFrame(rows, schema)).collect()}
    assert [(t["role"], t["content"]) for t in out[1]["turns"]] == [("", ""), ("user", ""), ("user", "b"), ("user", "b")]
    assert out[None]["turns"][0]["content"] == "[INST]" and out[2]["loss_spans"][0]["length"] == 0 and all(r["identical"] for r in out.values())
    assert chat.render_exchanges(spark.createDataFrame([], schema)).count() == 0


def test_reader_refuses_other_text(spark):
    out = spark.range(1).select(chat.parse(F.lit("<s>[INST] user [/INST]a</s>garbage")).alias("t")).first()["t"]
    assert out[0]["content"] == "a" and out[1]["role"] is None


def test_sentence_ends_of_many_scripts(spark):
    lines = ["एक दो तीन।", "আমরা যাই॥", "یہ ایک جملہ ہے۔", "هل هذا سؤال؟", "Սա նախադասություն է։", "ይህ ዓረፍተ ነገር ነው።", "これは文です。」", "នេះជាប្រយោគ។"]
    plain = ["एक दो तीन", "just some words", "Tous droits réservés.", "Alle Rechte vorbehalten.", "Todos los derechos reservados."]
    rows = spark.createDataFrame([(k, (line + "\n") * 3) for k, line in enumerate(lines + plain)], "post_id long, content string")
    lost = {r["post_id"]: r["n_lost_chars"] > 0 for r in quality.clean_lines(rows).collect()}
    assert lost == {k: k >= len(lines) for k in range(len(lines + plain))}
