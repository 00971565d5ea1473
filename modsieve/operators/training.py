"""Training-data preparation: answers to lines, paraphrases, noise, de-duplication, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.functions.text import copy_key, strip
from modsieve.operators.ranking import ranked
from modsieve.session import materialize

# everything that ends a line of text, line feed and carriage return or not
LINE_END = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"


def parse_lines(answers: DataFrame, key: str = "id", response: str = "response") -> DataFrame:
    """One row per line that holds a letter; a list number goes, i.e. all up to the first dot.

    A line without a dot is kept whole.
    """
    lines = answers.select(key, F.posexplode(F.split(strip(F.col(response)), LINE_END)).alias("line_no", "line"))
    line = strip(F.col("line"))
    dot = F.instr(line, ".")
    text = F.when(dot > 0, F.substr(line, dot + 1)).otherwise(line)
    return lines.filter(F.col("line").rlike(r"\p{L}")).select(key, "line_no", strip(text).alias("text"))


def noise_typo(text: Column, choice: Column) -> Column:
    """The first lower-case vowel is followed by an x in one of three cases."""
    return F.when(choice % 3 == 2, F.regexp_replace(text, r"^([^aeiou]*[aeiou])", "$1x")).otherwise(text)


def noise_suffix(text: Column, choice: Column) -> Column:
    return F.concat(text, F.get(F.array(*[F.lit(t) for t in K.NOISE_TAILS]), (choice % len(K.NOISE_TAILS)).cast("int")))


def noise_dollar(text: Column) -> Column:
    return F.regexp_replace(text, r"^([^s]*)s", r"$1\$")


def noise_case(text: Column, choice: Column) -> Column:
    return F.when(choice % 2 == 0, F.lower(text)).otherwise(F.upper(text))


def noise_hashtag(text: Column, choice: Column) -> Column:
    return F.concat(text, F.get(F.array(*[F.lit(t) for t in K.NOISE_TAGS]), (choice % len(K.NOISE_TAGS)).cast("int")))


def add_noise(text: Column, pattern: Column, choice: Column) -> Column:
    """Pattern 0..4 picks the kind of noise, ``choice`` the variant."""
    return (
        F.when(pattern == 0, noise_typo(text, choice)).when(pattern == 1, noise_suffix(text, choice))
        .when(pattern == 2, noise_dollar(text)).when(pattern == 3, noise_case(text, choice))
        .otherwise(noise_hashtag(text, choice))
    )


def sample_fraction(rows: DataFrame, fraction: float, order: str, label: str = "label", key: str = "id") -> DataFrame:
    """Exactly ``int(fraction * n)`` rows of every label, chosen by ``order``.

    Ranks come from :func:`ranked`, so a label with a third of all rows is not sorted in one task;
    only keys and order travel, whole rows are picked by a semi-join on the key.
    """
    thin = rows.select(key, label, order)
    sizes = thin.groupBy(label).agg(F.floor(F.count("*") * F.lit(fraction)).alias("_take"))
    taken = ranked(thin, order, [label], key).join(sizes, label).filter(F.col("row_number") <= F.col("_take"))
    return rows.join(taken.select(key), key, "left_semi")


def paraphrase_keep(pairs: DataFrame, original: str = "text", rewrite: str = "rewrite") -> DataFrame:
    """Rewrites that say something and differ from the original by more than case."""
    new = strip(F.col(rewrite))
    return pairs.withColumn(rewrite, new).filter((F.col(rewrite) != "") & (F.lower(rewrite) != F.lower(original)))


def dedup_keep_first(rows: DataFrame, text: str = "text", order: str = "id", groups: list[str] | None = None) -> DataFrame:
    """First row of every set of copies; ``order`` must be unique.

    Copies are found by a fixed-width digest and a minimum, both combined before the shuffle, so
    a third of all rows being the same post is one row per map task.  Texts are then picked by a
    semi-join on the unique ``order``; they never pass through the grouping.
    """
    return rows.join(first_copies(rows, text, order, groups).select(order), order, "left_semi")


def first_copies(rows: DataFrame, text: str = "text", order: str = "id", groups: list[str] | None = None) -> DataFrame:
    """Only the keys of :func:`dedup_keep_first`: ``order`` and the groups."""
    groups = groups or []
    keyed = rows.select(*groups, F.col(order), copy_key(F.col(text)).alias("_copy"))
    return keyed.groupBy(*groups, "_copy").agg(F.min(order).alias(order)).select(order, *groups)


def quota_per_label(rows: DataFrame, quota: dict[str, int], label: str = "label", order: str = "id") -> DataFrame:
    """First n rows of each label.  Keys are ranked alone; whole rows are picked by a semi-join on the key."""
    return rows.join(within_quota(rows.select(order, label), quota, label, order).select(order), order, "left_semi")


def within_quota(keys: DataFrame, quota: dict[str, int], label: str = "label", order: str = "id") -> DataFrame:
    """The first n keys of each label, for any n: no task sorts a whole label, see :func:`ranked`."""
    limit = None
    for name, n in quota.items():
        hit = F.col(label) == name
        limit = F.when(hit, n) if limit is None else limit.when(hit, n)
    return ranked(keys.filter(F.col(label).isin(list(quota))), order, [label], name="_place").filter(F.col("_place") <= limit).drop("_place")


def shuffle_rows(rows: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """A repeatable random order."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def label_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def build_training_set(base: DataFrame, rewrites: DataFrame, quota: dict[str, int] | None = None, seed: int = 42) -> DataFrame:
    """Per label: the first posts up to the quota, paraphrases of some, noisy variants of some, de-duplicated, cut again, shuffled.

    ``base`` holds ``id, text, label, pick_order, noise_order, noise_pattern, noise_choice``;
    ``rewrites`` holds ``id, rewrite``.  Sequence numbers keep base before paraphrases before noise:
    three consecutive id ranges of the width of the base ids.

    The quota comes first and sees keys only, so everything after it, and all that is written to the shared
    folder, has the size of the quota and not that of the corpus.
    """
    quota = quota or K.CLASS_QUOTA
    columns = ["id", "text", "label", "noise_order", "noise_pattern", "noise_choice"]
    cut = materialize(quota_per_label(base, quota), "base")
    span = cut.select(F.max("id") + 1).scalar()
    chosen = sample_fraction(cut, K.PARAPHRASE_FRACTION, "pick_order")
    kept = paraphrase_keep(chosen.join(rewrites, "id"))
    paraphrased = kept.select((F.col("id") + span).alias("id"), F.col("rewrite").alias("text"), *columns[2:])
    pool = materialize(cut.select(*columns).unionByName(paraphrased), "pool")
    noisy = materialize(sample_fraction(pool, K.NOISE_FRACTION, "noise_order").select(
        (F.col("id") + span * 2).alias("id"),
        add_noise(F.col("text"), F.col("noise_pattern"), F.col("noise_choice")).alias("text"), "label"), "noisy")
    together = pool.select("id", "text", "label").unionByName(noisy)
    unique = first_copies(together, groups=["label"])
    return shuffle_rows(together.join(within_quota(unique, quota).select("id"), "id", "left_semi"), seed)
