"""Numeric text features, one column each, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.functions import text as T
from modsieve.session import materialize

COUNT_FEATURES = [
    "num_words", "num_chars", "avg_word_len", "num_upper", "num_exclaims", "num_questions",
    "num_links", "num_mentions", "num_dollar", "num_hashtags", "num_digits", "num_punct",
    "stopword_count", "unique_words", "all_caps", "starts_with_http", "frac_upper", "frac_stopwords",
]
KEYWORD_FEATURES = ["keyword_present", "keyword_count"]
PHRASE_FEATURES = ["phrase_" + phrase.replace(" ", "_") for phrase in K.SCAM_PHRASES]
PATTERN_FEATURES = [f"regex_match_{i}" for i in range(len(K.FEATURE_PATTERNS))]
# every match of pattern i holds one of these; a substring search is far cheaper than the pattern
PATTERN_HINTS = [["%"], ["bitcoin", "ethereum", "crypto"], ["make $"], ["risk", "fees"], ["cash", "money"]]
BASE_FEATURES = COUNT_FEATURES + KEYWORD_FEATURES + PHRASE_FEATURES + PATTERN_FEATURES


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def _holds_any(column: str, parts: list[str]) -> Column:
    out = F.contains(column, F.lit(parts[0]))
    for part in parts[1:]:
        out = out | F.contains(column, F.lit(part))
    return out


def with_tokens(posts: DataFrame, content: str = "content") -> DataFrame:
    """Append ``_tokens``, written to the shared folder: cutting costs more than all other features, and features and TF-IDF, fit and weights, share it."""
    return materialize(posts.withColumn("_tokens", T.tokens(F.col(content))), "tokens")


def count_features(posts: DataFrame, content: str = "content", tokens: str | None = None) -> DataFrame:
    """Append the eighteen counts and ratios.  Tokens are cut once and reused, or are a column already."""
    text = F.col(content)
    cut = posts.withColumn("_tokens", F.col(tokens) if tokens else T.tokens(text))
    counted = cut.withColumns({
        "num_words": F.size("_tokens"),
        "num_chars": F.length(text),
        "num_upper": T.count_pattern(text, r"\p{IsUppercase}"),
        "num_exclaims": T.count_char(text, "!"),
        "num_questions": T.count_char(text, "?"),
        "num_links": F.when(F.contains(F.lower(text), F.lit("http")), T.count_pattern(F.lower(text), K.URL_PATTERN)).otherwise(0),
        "num_mentions": T.count_char(text, "@"),
        "num_dollar": T.count_char(text, "$"),
        "num_hashtags": T.count_char(text, "#"),
        "num_digits": T.count_digits(text),
        "num_punct": T.count_pattern(text, K.PUNCTUATION),
        "stopword_count": F.size(F.filter("_tokens", lambda t: t.isin(*K.STOP_WORDS))),
        "unique_words": F.size(F.array_distinct("_tokens")),
        "all_caps": _flag(text.rlike(r"\p{IsUppercase}") & ~text.rlike(r"[\p{IsLowercase}\p{Lt}]")),
        "starts_with_http": _flag(T.starts_with_http(F.lower(text))),
    })
    ready = counted.withColumns({
        "avg_word_len": T.ratio(F.col("num_chars"), F.col("num_words")),
        "frac_upper": T.ratio(F.col("num_upper"), F.col("num_chars")),
        "frac_stopwords": T.ratio(F.col("stopword_count"), F.col("num_words")),
    })
    return ready if tokens else ready.drop("_tokens")


def keyword_features(posts: DataFrame, keywords: list[str], content: str = "content") -> DataFrame:
    """Plain substring presence and non-overlapping occurrence count over all keywords."""
    lowered = posts.withColumn("_lower", F.lower(F.col(content)))
    total = F.lit(0)
    for keyword in keywords:
        key = keyword.lower()
        # removing every occurrence shortens the text by len(key) per occurrence
        total = total + F.when(
            F.contains("_lower", F.lit(key)),
            (F.length("_lower") - F.length(F.replace("_lower", F.lit(key), F.lit("")))) / len(key),
        ).otherwise(0).cast("int")
    counted = lowered.withColumn("keyword_count", total)
    return counted.withColumn("keyword_present", _flag(F.col("keyword_count") > 0)).drop("_lower")


def phrase_features(posts: DataFrame, content: str = "content") -> DataFrame:
    lowered = posts.withColumn("_lower", F.lower(F.col(content)))
    return lowered.withColumns({
        name: _flag(F.contains("_lower", F.lit(phrase))) for name, phrase in zip(PHRASE_FEATURES, K.SCAM_PHRASES)
    }).drop("_lower")


def pattern_features(posts: DataFrame, content: str = "content") -> DataFrame:
    lowered = posts.withColumn("_lower", F.lower(F.col(content)))
    return lowered.withColumns({
        name: _flag(_holds_any("_lower", hints) & F.rlike("_lower", F.lit(pattern)))
        for name, pattern, hints in zip(PATTERN_FEATURES, K.FEATURE_PATTERNS, PATTERN_HINTS)
    }).drop("_lower")


def extract_features(posts: DataFrame, keywords: list[str] | None = None, content: str = "content", tokens: str | None = None) -> DataFrame:
    """All 51 base features, in :data:`BASE_FEATURES` order, after the frame's own columns."""
    own = posts.columns
    wide = pattern_features(
        phrase_features(
            keyword_features(count_features(posts, content, tokens), keywords if keywords is not None else K.SCAM_PHRASES,
                             content),
            content),
        content)
    return wide.select(*own, *BASE_FEATURES)


def feature_frame(wide: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """Pin features to a stored name list: that order, all as double, a missing name is an error."""
    missing = [n for n in names if n not in wide.columns]
    if missing:
        raise ValueError(f"features missing: {missing}")
    return wide.select(*keep, *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
