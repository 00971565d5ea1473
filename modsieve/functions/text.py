"""Scalar text functions.  Every one is a built-in column expression and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modsieve import constants as K


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends (``trim`` only knows blanks)."""
    return F.regexp_replace(text, f"^{K.SPACE}+|{K.SPACE}+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{K.SPACE}+", "")


def starts_with_http(lowered: Column) -> Column:
    """Few texts hold the word at all; only these are trimmed."""
    return F.contains(lowered, F.lit("http")) & F.startswith(lstrip(lowered), F.lit("http"))


def is_blank(text: Column) -> Column:
    return ~text.rlike(K.NON_SPACE)


def squash(text: Column) -> Column:
    """Lower case, ASCII letters and digits only: the form fuzzy keywords are looked up in."""
    # lower case of the letters that are left is far cheaper than that of a text with other scripts; only two other characters,
    # a dotted I and the Kelvin sign, become ASCII letters in lower case
    rare = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    return F.when(rare, F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")).otherwise(F.lower(F.regexp_replace(text, r"\P{Alnum}+", "")))


def normal_form(text: Column) -> Column:
    """Drop everything that is not a word character, lower the rest: equal forms are copies."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", ""))


def copy_key(text: Column) -> Column:
    """Fixed-width stand-in for :func:`normal_form`, so shuffles never carry whole texts."""
    return F.sha2(normal_form(text), 256)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"{K.WORD}+"), F.lit(0))


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def count_pattern(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_digits(text: Column) -> Column:
    """Decimal digits, and superscripts and circled digits where a post has such number signs at all."""
    return F.when(text.rlike(r"\p{No}"), count_pattern(text, K.DIGIT)).otherwise(count_pattern(text, r"\p{Nd}"))


def snippet(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, 0 when there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def decimals3(number: Column) -> Column:
    return F.format_string("%.3f", number)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
