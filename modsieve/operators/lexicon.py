"""Fuzzy keyword lexicons.

A keyword hits when its letters and digits occur in order in the squashed post with at most two
foreign characters between neighbours, anywhere, across word borders.  Keywords are ordered and
the first one in list order is the one reported.

A lexicon travels inside the plan, so that every post meets it without a shuffle.  A table of keywords
of any size is taken in blocks of ``BLOCK_KEYWORDS``, one after the other: each is one pass over the posts that adds its hits to
one table in the shared folder, and the result is a read of that table.  So the driver and every plan hold one block in
pattern form, however many keywords there are.  Keywords keep the numbers their table gives them.

Up to ``CHAIN_LIMIT`` keywords the first hit is a CASE chain of constant patterns.  Above that the
keywords form a tree: one combined pattern for the whole list decides hit or no hit (most posts
stop there), then the first matching block, row and keyword are looked up only for posts that hit.
Combined patterns share prefixes, so their cost grows far slower than the list.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsieve import constants as K
from modsieve.functions.text import squash
from modsieve.operators.rows import expand
from modsieve.session import scratch_path

CHAIN_LIMIT = 48
BLOCK = 256
ROW = 16
BLOCK_KEYWORDS = 10_000
GAP = ".{0,2}"


def squash_keyword(keyword: str) -> str:
    return re.sub("[^a-z0-9]", "", keyword.lower())


def fuzzy_pattern(keyword: str) -> str:
    return GAP.join(squash_keyword(keyword))


def combined_pattern(keywords: list[str]) -> str:
    """One pattern that matches exactly the texts at least one keyword hits."""
    tree: dict = {}
    for keyword in keywords:
        node = tree
        for char in squash_keyword(keyword):
            node = node.setdefault(char, {})
        node["end"] = {}

    def render(node: dict) -> str:
        if "end" in node:  # a shorter keyword ends here, longer ones add nothing to a yes/no answer
            return ""
        parts = [char + (GAP + rest if rest else "") for char, rest in
                 ((char, render(child)) for char, child in sorted(node.items()))]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return render(tree)


#: Letters and digits from the most to the least frequent in text: a part that begins with rare ones is tried at few places.
COMMON = "etaoinsrhldcumfpgwybvk0123456789xjqz"
PART = 10


def rare_part(keyword: str, letters: int = PART) -> str:
    """``letters`` neighbouring letters of a squashed keyword, from where its letters are rarest; whatever the keyword hits, the part hits."""
    clean = squash_keyword(keyword)
    starts = range(max(1, len(clean) - letters + 1))
    best = max(starts, key=lambda i: 2 * COMMON.index(clean[i]) + sum(COMMON.index(c) for c in clean[i + 1:i + 2]))
    return clean[best:best + letters]


@dataclass(frozen=True)
class Lexicon:
    """Ordered keywords and their numbers; entries that squash to nothing would hit every post and are left out."""

    keywords: tuple[str, ...]
    numbers: tuple[int, ...] = ()

    @staticmethod
    def of(keywords: list[str] | tuple[str, ...], numbers: list[int] | None = None) -> "Lexicon":
        """Keywords in order, numbered from 0 unless ``numbers`` says otherwise."""
        kept = [(n, k) for n, k in zip(numbers if numbers is not None else range(len(keywords)), keywords) if squash_keyword(k)]
        return Lexicon(tuple(k for _, k in kept), tuple(n for n, _ in kept))

    @staticmethod
    def default() -> "Lexicon":
        return Lexicon.of(K.DEFAULT_RULE_KEYWORDS)

    @staticmethod
    def from_table(table: DataFrame) -> "Lexicon":
        """A whole ``(kw_idx, keyword)`` table as one lexicon: for lists that people curate.  See :func:`keyword_blocks`."""
        rows = table.select("kw_idx", "keyword").orderBy("kw_idx").collect()
        return Lexicon.of([row.keyword for row in rows], [row.kw_idx for row in rows])

    def number_at(self, position: Column) -> Column:
        """The table's number of the keyword at a position."""
        if self.numbers == tuple(range(len(self.keywords))):
            return position.cast("long")
        return F.get(_strings([str(n) for n in self.numbers]), position).cast("long")

    def blocks(self, size: int) -> list[tuple[str, ...]]:
        return [self.keywords[i:i + size] for i in range(0, len(self.keywords), size)]

    def any_hit(self, squashed: Column) -> Column:
        if not self.keywords:
            return F.lit(False)
        return squashed.rlike(combined_pattern(list(self.keywords)))

    def may_hit(self, squashed: Column) -> Column:
        """Whether a rare part of a keyword hits: true wherever a keyword does, and seldom elsewhere; far cheaper than :meth:`any_hit`."""
        if not self.keywords:
            return F.lit(False)
        return squashed.rlike(combined_pattern(sorted({rare_part(k) for k in self.keywords})))

    def first_hit(self, squashed: Column) -> Column:
        """Position of the first keyword in list order that hits, null when none does."""
        if not self.keywords:
            return F.lit(None).cast("int")
        if len(self.keywords) <= CHAIN_LIMIT:
            out = None
            for position, keyword in enumerate(self.keywords):
                hit = squashed.rlike(fuzzy_pattern(keyword))
                out = F.when(hit, position) if out is None else out.when(hit, position)
            return out.cast("int")
        row = None
        for number, block in enumerate(self.blocks(BLOCK)):
            hit = squashed.rlike(combined_pattern(list(block)))
            inside = _first_row(squashed, block, number * (BLOCK // ROW))
            row = F.when(hit, inside) if row is None else row.when(hit, inside)
        patterns = self._row_patterns()

        def in_row(r: Column) -> Column:
            tried = F.transform(F.split(F.get(patterns, r), SEPARATOR), lambda p: F.rlike(squashed, p))
            return (r * ROW + F.array_position(tried, True) - 1).cast("int")

        # the one-element list binds the row number, which is needed twice but found once
        bound = F.array(F.when(self.may_hit(squashed), row))
        return F.get(F.transform(bound, lambda r: F.when(r.isNotNull(), in_row(r))), F.lit(0))

    def all_hits(self, squashed: Column) -> Column:
        """Positions of all keywords that hit, ascending."""
        if not self.keywords:
            return _no_hits()
        rows = []
        for number, block in enumerate(self.blocks(BLOCK)):
            hit = squashed.rlike(combined_pattern(list(block)))
            rows.append(F.when(hit, _all_rows(squashed, block, number * (BLOCK // ROW))).otherwise(_no_hits()))
        rows_hit = rows[0] if len(rows) == 1 else F.concat(*rows)
        patterns = self._row_patterns()

        def in_row(r: Column) -> Column:
            return F.array_compact(F.transform(
                F.split(F.get(patterns, r), SEPARATOR),
                lambda p, i: F.when(F.rlike(squashed, p), r * ROW + i)))

        found = F.flatten(F.transform(rows_hit, in_row))
        return F.when(self.may_hit(squashed), found).otherwise(_no_hits())

    def _row_patterns(self) -> Column:
        """The fuzzy patterns of each row of keywords, joined: a constant list."""
        joined = [SEPARATOR.join(fuzzy_pattern(k) for k in row) for row in self.blocks(ROW)]
        return _strings(joined, ROW_SEPARATOR)

    def keyword_at(self, position: Column) -> Column:
        if not self.keywords:
            return F.lit(None).cast("string")
        return F.get(_strings(self.keywords), position)


def _no_hits() -> Column:
    return F.array().cast("array<int>")


SEPARATOR, ROW_SEPARATOR = "\u0001", "\u0002"


def _strings(values, separator: str = SEPARATOR) -> Column:
    """A constant list.  One literal that is cut once when the plan is folded: building a literal
    per entry takes seconds for thousands of keywords."""
    values = list(values)
    if any(separator in v for v in values):
        return F.array(*[F.lit(v) for v in values])
    return F.split(F.lit(separator.join(values)), separator, -1)


def _rows(block: tuple[str, ...]) -> list[tuple[str, ...]]:
    return [block[i:i + ROW] for i in range(0, len(block), ROW)]


def _first_row(squashed: Column, block: tuple[str, ...], offset: int) -> Column:
    """Number of the first row of keywords with a hit; row patterns are constants, compiled once."""
    out = None
    for number, row in enumerate(_rows(block)):
        hit = squashed.rlike(combined_pattern(list(row)))
        out = F.when(hit, offset + number) if out is None else out.when(hit, offset + number)
    return out


def _all_rows(squashed: Column, block: tuple[str, ...], offset: int) -> Column:
    return F.array_compact(F.array(*[
        F.when(squashed.rlike(combined_pattern(list(row))), offset + number) for number, row in enumerate(_rows(block))
    ]))


def fuzzy_match(text: Column, keyword: str) -> Column:
    """Does one keyword hit this text?"""
    return squash(text).rlike(fuzzy_pattern(keyword))


def keyword_blocks(table: DataFrame, size: int = BLOCK_KEYWORDS) -> Iterator[Lexicon]:
    """The keywords of a table in order, ``size`` at a time; the driver never holds more than a block and a partition."""
    rows = table.select("kw_idx", "keyword").orderBy("kw_idx").toLocalIterator()
    while block := list(itertools.islice(rows, size)):
        yield Lexicon.of([row.keyword for row in block], [row.kw_idx for row in block])


def _united(posts: DataFrame, keywords: Lexicon | DataFrame, hits: Callable[[DataFrame, Lexicon], DataFrame]) -> DataFrame:
    if isinstance(keywords, Lexicon):
        return hits(posts, keywords)
    path = scratch_path(posts.sparkSession, "keyword_hits")
    schema = hits(posts, Lexicon.of([])).schema
    posts.sparkSession.createDataFrame([], schema).write.parquet(path)
    for block in keyword_blocks(keywords):
        hits(posts, block).write.mode("append").parquet(path)
    return posts.sparkSession.read.schema(schema).parquet(path)


def lexicon_hits(posts: DataFrame, keywords: Lexicon | DataFrame) -> DataFrame:
    """One row ``(post_id, kw_idx, keyword)`` per post and keyword that hits; a lexicon, or a table of any size."""
    return _united(posts, keywords, _block_hits)


def _block_hits(posts: DataFrame, lexicon: Lexicon) -> DataFrame:
    squashed = posts.select("post_id", squash(F.col("content")).alias("squashed"))
    listed = squashed.select("post_id", lexicon.all_hits(F.col("squashed")).alias("found"))
    hits = expand(listed, "found", "position", "post_id")
    return hits.select("post_id", lexicon.number_at(F.col("position")).alias("kw_idx"), lexicon.keyword_at(F.col("position")).alias("keyword"))


def first_hits(posts: DataFrame, keywords: Lexicon | DataFrame) -> DataFrame:
    """``(post_id, kw_idx, keyword)`` of the first keyword in list order, for posts that have one."""
    found = _united(posts, keywords, _block_first)
    return found if isinstance(keywords, Lexicon) else first_hit_per_post(found)


def _block_first(posts: DataFrame, lexicon: Lexicon) -> DataFrame:
    squashed = posts.select("post_id", squash(F.col("content")).alias("squashed"))
    found = squashed.select("post_id", F.array(lexicon.first_hit(F.col("squashed"))).alias("found"))
    hits = expand(found, "found", "position", "post_id")
    return hits.select("post_id", lexicon.number_at(F.col("position")).alias("kw_idx"), lexicon.keyword_at(F.col("position")).alias("keyword"))


def first_hit_per_post(hits: DataFrame) -> DataFrame:
    """The keyword with the lowest list position per post, from :func:`lexicon_hits`."""
    return hits.groupBy("post_id").agg(
        F.min("kw_idx").alias("kw_idx"), F.min_by("keyword", "kw_idx").alias("keyword")
    )


def lexicon_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new keywords without repeats, old order first; ``(kw_idx, keyword)`` in and out.

    The kept position is the lowest one; new keywords are placed after the old ones.  Dropped repeats leave holes
    in the numbers, which all users of a lexicon keep.
    """
    last = old.select(F.coalesce(F.max("kw_idx"), F.lit(-1)).cast("long")).scalar()
    shifted = new.select((F.col("kw_idx") + last + 1).alias("kw_idx"), "keyword")
    both = old.select(F.col("kw_idx").cast("long").alias("kw_idx"), "keyword").unionByName(shifted)
    return both.groupBy("keyword").agg(F.min("kw_idx").alias("kw_idx")).select("kw_idx", "keyword")
