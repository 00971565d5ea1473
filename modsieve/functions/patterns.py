"""Payment-address and link checks of the rules stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modsieve import constants as K


def _long_run(text: Column) -> Column:
    """A border and 26 letters or digits: part of every match of two patterns."""
    # the named class is one table look-up; a class of three ranges costs several times as much
    run = r"\p{Alnum}{26}"
    return F.rlike(F.substr(text, F.lit(1), F.lit(26)), F.lit(f"^{run}")) | text.rlike(rf"\P{{Alnum}}{run}")


#: What every match of the patterns holds; looking for it is far cheaper than looking back for a word border at every character.
ADDRESS_HINTS = [
    (lambda text: F.contains(text, F.lit("$")), ["cash_tag"]),
    (lambda text: F.contains(text, F.lit("0x")), ["ethereum"]),
    (lambda text: text.rlike("[0-9]{2}[A-Z0-9]{4}[0-9]{7}"), ["iban"]),
    (_long_run, ["bitcoin", "long_token"]),
]


def has_address(text: Column) -> Column:
    hit = F.lit(False)
    for hint, names in ADDRESS_HINTS:
        found = F.lit(False)
        for name in names:
            found = found | text.rlike(K.ADDRESS_PATTERNS[name])
        hit = hit | (hint(text) & found)
    return hit


def address_kinds(text: Column) -> Column:
    """Names of all address patterns found, in pattern order."""
    hints = {name: hint for hint, names in ADDRESS_HINTS for name in names}
    return F.array_compact(
        F.array(*[F.when(hints[name](text) & text.rlike(p), F.lit(name)) for name, p in K.ADDRESS_PATTERNS.items()])
    )


def has_url(text: Column) -> Column:
    return text.rlike(K.URL_PATTERN)


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(K.URL_PATTERN), F.lit(0))
