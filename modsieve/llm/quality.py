"""Line-first cleaning of posts: judge every line, drop those that fail, reject posts that lose too much.

Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.

Edge cases: a null or empty content has no word and no line, fails and is rejected; lines without a word are neither
judged nor counted; repeated rows are judged alike; an empty table gives an empty table; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsieve.llm.carry import Carried

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: What a line of prose ends with somewhere, and what boilerplate lines say.
# Latin and full-width marks; danda and double danda; Arabic question mark, semicolon and Urdu full stop; Armenian, Ethiopic, Khmer,
# Myanmar and Tibetan full stops; closing quotes and brackets may follow.
SENTENCE_END = r"[.!?;:…。！？．；：｡।॥؟؛۔։።፧។။།][\"'”’»)\]」』）］】》]*([\x20\x09-\x0D]|$)"
# English, French, German, Spanish
BOILERPLATE = [
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "accept cookies", "enable javascript", "lorem ipsum", "subscribe to our newsletter", "sign up for our",
    "powered by", "copyright ©", "(c) copyright", "permission is hereby granted",
    "tous droits réservés", "conditions d'utilisation", "conditions générales", "politique de confidentialité", "mentions légales", "accepter les cookies",
    "activer javascript", "abonnez-vous à notre",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "javascript aktivieren",
    "abonnieren sie unseren",
    "todos los derechos reservados", "términos de uso", "términos y condiciones", "política de privacidad", "aviso legal", "aceptar cookies",
    "activar javascript", "suscríbete a nuestro",
]
NAVIGATION = r"(^|[\x20\x09-\x0D])([|»›>•·/\\]|::|->|=>)([\x20\x09-\x0D]|$)"

#: A line with at least this many separators per hundred words is navigation.
NAVIGATION_PERCENT = 20
#: A line with more than this many symbols per hundred characters has no prose punctuation.
SYMBOL_PERCENT = 10
#: A window position takes this many bits beside a shortened hash; longer texts compare whole windows.
PLACE_BITS = 24


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows found twice or more, the first find included.

    Shortened window hashes and positions, packed into one number each, are sorted; neighbours with equal hashes are
    candidates.  Candidates are compared by their words, again by sorting, so unequal windows never count.
    A word counts once, however many windows cover it.
    """
    windows = F.size(words) - 2
    places = F.sequence(F.lit(0), windows - 1)

    def grams(at: Column) -> Column:
        return F.transform(at, lambda p: F.struct(
            F.get(words, p).alias("a"), F.get(words, p + 1).alias("b"), F.get(words, p + 2).alias("c"), p.cast("int").alias("p")))

    def packed() -> Column:
        return F.sort_array(F.transform(F.slice(words, 1, windows), lambda w, p: F.shiftleft(
            F.xxhash64(w, F.get(words, p + 1), F.get(words, p + 2)), PLACE_BITS).bitwiseOR(p.cast("long"))))

    def candidates(codes: Column) -> Column:
        def hash_at(k: Column) -> Column:
            return F.shiftright(F.get(codes, k), PLACE_BITS)

        def alike(c: Column, k: Column) -> Column:
            own = F.shiftright(c, PLACE_BITS)
            return F.coalesce(own == hash_at(k - 1), F.lit(False)) | F.coalesce(own == hash_at(k + 1), F.lit(False))

        return F.transform(F.filter(codes, alike), lambda c: c.bitwiseAND((1 << PLACE_BITS) - 1).cast("int"))

    def covered(at: Column) -> Column:
        def counted(sorted_grams: Column) -> Column:
            def same(g: Column, k: Column) -> Column:
                other = F.get(sorted_grams, k)
                return F.coalesce((g["a"] == other["a"]) & (g["b"] == other["b"]) & (g["c"] == other["c"]), F.lit(False))

            repeated = F.filter(sorted_grams, lambda g, k: same(g, k - 1) | same(g, k + 1))
            return let(F.sort_array(F.transform(repeated, lambda g: g["p"])), lambda ps: F.aggregate(
                F.transform(ps, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(ps, k + 1) - p, F.lit(3))).cast("long")),
                F.lit(0).cast("long"), lambda total, n: total + n))

        return F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(let(F.sort_array(grams(at)), counted))

    short = F.size(words) < (1 << PLACE_BITS)
    return F.when(windows < 2, F.lit(0).cast("long")).otherwise(
        let(F.when(short, let(packed(), candidates)).otherwise(places.cast("array<int>")), covered))


def line_fails(line: Column) -> Column:
    """Whether a line is boilerplate, navigation, or without the punctuation of prose: no sentence mark, or littered with symbols."""
    def says(low: Column) -> Column:
        found = F.lit(False)
        for phrase in BOILERPLATE:
            found = found | F.contains(low, F.lit(phrase))
        return found

    boilerplate = let(F.lower(line), says)
    n_words = F.regexp_count(line, F.lit(WORD))
    navigation = F.regexp_count(line, F.lit(NAVIGATION)) * 100 >= n_words * NAVIGATION_PERCENT
    symbols = (F.length(line) - F.length(F.regexp_replace(line, SYMBOL, ""))) * 100 > F.length(line) * SYMBOL_PERCENT
    return boilerplate | navigation | symbols | ~line.rlike(SENTENCE_END)


def clean_lines(posts: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, max_loss_percent: int = 50) -> DataFrame:
    """``posts`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``cleaned`` (the content without its failed lines), ``n_lost_chars`` and ``kept``.

    A post is base-failed below ``min_words`` words, or with more than ``max_repeat_percent`` of its words in repeated
    windows.  It is kept if it is not, and if the failed lines hold at most ``max_loss_percent`` of its word characters.
    Everything happens inside a row, in built-in functions: no shuffle.
    """
    carried = Carried(posts)
    content = F.coalesce(carried["content"].cast("string"), F.lit(""))
    split = carried.frame.withColumn("_content", content).withColumn("_words", F.regexp_extract_all("_content", F.lit(WORD), F.lit(0))).withColumn(
        "_lines", F.filter(F.split("_content", "\n"), lambda line: line.rlike(WORD)))
    judged = split.withColumn("_good", F.filter("_lines", lambda line: ~line_fails(line)))
    joined = F.array_join("_words", "")

    def word_chars(lines: Column) -> Column:
        return F.length(F.regexp_replace(F.array_join(lines, ""), r"[\x20\x09-\x0D]+", "")).cast("long")

    measured = judged.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(joined).cast("long"),
        "n_symbols": (F.length(joined) - F.length(F.regexp_replace(joined, SYMBOL, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_words")),
        "cleaned": F.array_join("_good", "\n"),
        "_kept_chars": word_chars(F.col("_good")),
    })
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    lost = F.col("word_chars") - F.col("_kept_chars")
    verdict = measured.withColumns({
        "base_failed": failed, "n_lost_chars": lost, "kept": ~failed & (lost * 100 <= F.col("word_chars") * max_loss_percent)})
    return carried.restore(verdict, [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "n_lost_chars", "kept"])
