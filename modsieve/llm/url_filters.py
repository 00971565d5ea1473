"""Block and accept lists for the links of posts, by cascades of Bloom filters.

A rule is a host and the beginning of a path (``example.net/en/``) with a decision.  It fits its host and all subdomains
if the link's path starts with the rule's; the longest rule wins, then the longer host, then ``BLOCK``.

The first filter of a cascade encodes the listed rules, the second those keys of the corpus that pass the first by mistake, the third
the listed ones that pass the second by mistake, and so on until no mistake is left.  Since the mistakes are sought among
all keys that any link of the corpus has, membership is exact for all of them, and a link is judged by its own row
alone: no join, no shuffle.

Edge cases: a null link, or one without ``://``, has an empty host and path and fits no rule; a link without a path has
an empty one; rules that are null, without a host or with another decision than ``ACCEPT`` and ``BLOCK`` are left out, and
so are repeated ones; without rules everything is ``ACCEPT``; repeated links are judged row by row; an empty
table gives an empty table; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsieve.functions.patterns import urls
from modsieve.llm.carry import Carried
from modsieve.operators.rows import expand
from modsieve.session import materialize

ACCEPT, BLOCK = "ACCEPT", "BLOCK"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of one cascade's first filter, the largest; all filters are literals of the plan.  Lists that need more are dealt into
#: several cascades by a hash of the rule, and the links are passed once for each.
MOST_BITS = 1 << 22


def links_of(posts: DataFrame) -> DataFrame:
    """``post_id`` and ``url``, one row for every link in the ``content`` of ``posts``."""
    found = posts.select("post_id", urls(F.col("content").cast("string")).alias("_urls"))
    return expand(found, "_urls", "url", "post_id")


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), PARTS, 1), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), PARTS, 2)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _longs(values: list[int]) -> Column:
    """One array literal of any length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


@dataclass(frozen=True)
class BloomFilter:
    """``words`` of 64 bits; a key sets ``hashes`` of the ``bits``.  Every ``seed`` is a filter of its own kind."""

    seed: int
    bits: int
    hashes: int
    words: tuple[int, ...] = ()

    @staticmethod
    def sized(seed: int, keys: int, mistakes: float) -> BloomFilter:
        """Room for so many keys at that share of mistakes."""
        halvings = max(1.0, -math.log2(mistakes))
        return BloomFilter(seed, max(64, math.ceil(keys * halvings / math.log(2))), max(1, round(halvings)))

    def positions(self, key: Column) -> Column:
        spread = lambda h: F.transform(
            F.sequence(F.lit(0), F.lit(self.hashes - 1)),
            lambda i: F.pmod(h.bitwiseAND(0xFFFFFFFF) + i * F.shiftrightunsigned(h, 32).bitwiseOR(1), F.lit(self.bits).cast("long")))
        return _let(F.xxhash64(F.lit(self.seed), key), spread)

    def filled(self, keys: DataFrame) -> BloomFilter:
        """With the ``key`` of all rows; the bits of a word are put together before the shuffle, and at most ``bits`` / 64 words come back."""
        at = keys.select(F.explode(self.positions(F.col("key"))).alias("at"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
        found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
        words = dict(map(tuple, found))
        return BloomFilter(self.seed, self.bits, self.hashes, tuple(words.get(k, 0) for k in range(-(-self.bits // 64))))

    def passes(self, key: Column) -> Column:
        def is_set(words: Column, at: Column) -> Column:
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            return F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

        return _let(_longs(list(self.words)), lambda words: F.forall(self.positions(key), lambda at: is_set(words, at)))


@dataclass(frozen=True)
class Cascade:
    """Filters in turn: the even ones encode listed keys, the odd ones keys that are not listed."""

    filters: tuple[BloomFilter, ...]

    def contains(self, key: Column) -> Column:
        """Whether a key of the corpus the cascade was made for is listed."""
        found = F.lit(len(self.filters) % 2 == 1)
        for k in reversed(range(len(self.filters))):
            through = self.filters[k].passes(key)
            found = through & found if k % 2 == 0 else ~through | found
        return found


def build_cascade(keys: DataFrame, listed: DataFrame) -> Cascade:
    """The cascade that tells ``listed`` (distinct ``key``) from all other ``key`` of ``keys``, the corpus's.

    The first filter lets about as many others through as keys are listed, whatever the corpus's size, and each further one half:
    1.44 bits a key for every doubling of the corpus over the list, and about 4 more.
    """
    n = listed.count()
    if not n:
        return Cascade(())
    others = keys.agg(F.approx_count_distinct("key")).first()[0]
    filters = [BloomFilter.sized(0, n, min(0.5, n / (math.sqrt(2) * max(1, others)))).filled(listed)]
    mistakes = materialize(keys.filter(filters[0].passes(F.col("key"))).distinct().join(listed, "key", "left_anti"), "mistakes")
    encoded = listed
    while left := mistakes.count():
        level = BloomFilter.sized(len(filters), left, 0.5).filled(mistakes)
        filters.append(level)
        mistakes, encoded = materialize(encoded.filter(level.passes(F.col("key"))), "mistakes"), mistakes
    return Cascade(tuple(filters))


def _rule_keys(rules: DataFrame) -> DataFrame:
    """``key`` (decision and rule), ``labels`` of the rule's host and ``chars`` of its path, distinct."""
    name = F.col("rule").cast("string")
    host, path = F.translate(F.regexp_extract(name, "(?s)^([^/]*)(.*)$", 1), CAPITALS, SMALL), F.regexp_extract(name, "(?s)^([^/]*)(.*)$", 2)
    known = rules.filter(F.col("decision").isin(ACCEPT, BLOCK)).select("decision", host.alias("host"), path.alias("path")).filter("host <> ''")
    return known.select(
        F.concat_ws(" ", "decision", F.concat("host", "path")).alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct()


def _candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The rules that would fit a link: for every shape of a rule (labels of its host, characters of its path) one with either decision.

    Structs in the order of preference: length, length of the host, whether it blocks, the rule, the key.
    """
    def of(shape: Column) -> Column:
        labels, chars = F.shiftright(shape, 32).cast("int"), shape.bitwiseAND(0xFFFFFFFF).cast("int")
        suffix = F.call_function("substring_index", host, F.lit("."), -labels)
        rule = F.concat(suffix, F.left(path, chars))
        fits = (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= chars)
        pair = F.array(*[F.struct(
            F.length(rule).alias("length"), F.length(suffix).alias("host"), F.lit(decision == BLOCK).alias("blocks"), rule.alias("rule"),
            F.concat_ws(" ", F.lit(decision), rule).alias("key")) for decision in (ACCEPT, BLOCK)])
        return F.when(fits, pair)

    return F.flatten(F.array_compact(F.transform(_longs([labels << 32 | chars for labels, chars in shapes]), of)))


def judge_links(links: DataFrame, rules: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``links`` with ``host``, ``path``, ``rule`` (the one that decides, else null) and ``decision``, ``ACCEPT`` where no rule fits.

    ``links`` has ``url``, ``rules`` has ``rule`` and ``decision``.  The links are read to count their keys, to find what
    passes the first filter, and to be judged; nothing of them is shuffled but keys that pass that filter.
    """
    listed = materialize(_rule_keys(rules), "rules")
    shapes = [(r["labels"], r["chars"]) for r in listed.select("labels", "chars").distinct().collect()]
    carried = Carried(links)
    judged = carried.frame.withColumns({"host": host_of(carried["url"]), "path": path_of(carried["url"]), "_best": F.lit(None).cast(
        "struct<length:int,host:int,blocks:boolean,rule:string,key:string>")})
    if shapes:
        fitting = _candidates(F.col("host"), F.col("path"), shapes)
        keys = expand(judged.select(fitting.alias("_fitting")), "_fitting", "_one").select("_one.key")
        others = max(2, keys.agg(F.approx_count_distinct("key")).first()[0])
        n = listed.count()
        slices = max(1, math.ceil(n * max(1.0, math.log2(math.sqrt(2) * others / n)) / math.log(2) / most_bits))
        of = lambda key: F.pmod(F.xxhash64(F.lit("slice"), key), F.lit(slices))
        for k in range(slices):
            cascade = build_cascade(keys.filter(of(F.col("key")) == k), listed.select("key").filter(of(F.col("key")) == k))
            mine = F.filter(fitting, lambda one: (of(one["key"]) == k) & cascade.contains(one["key"]))
            judged = judged.withColumn("_best", F.greatest("_best", F.array_max(mine)))
            if k + 1 < slices:
                judged = materialize(judged, "judged")
    return carried.restore(judged.withColumns({
        "rule": F.col("_best")["rule"], "decision": F.when(F.col("_best")["blocks"], BLOCK).otherwise(ACCEPT)}), ["host", "path", "rule", "decision"])
