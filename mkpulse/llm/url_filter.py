"""URL filters by a Bloom filter cascade.

A rule is a host and a path beginning. Every url has a few keys: for each
shape that occurs among the rules (labels of the host, characters of the
path), its last labels followed by its first path characters. The key
universe is the distinct keys of all urls of the corpus. Level one of the
cascade is a Bloom filter of the listed keys; level two one of the other keys
that level one also hits; level three one of the listed keys that level two
also hits; and so on until nothing is hit wrongly. For every key of the
universe the answer is exact, and urls are judged by bit tests alone, without
a join.

The filters are literals of the plan. Their size follows the list, about
1.44 log2(1/p) bits a listed key and at most ``MAX_BITS`` (checked, else
ValueError); it does not follow the corpus.

Defined results: a url that is null or has no ``://`` has an empty host and
path and no keys; equal rules of both verdicts block; repeated rows are judged
each; without rules no url has one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mkpulse.llm.common import materialize

#: Host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Hosts that are blocked, with their subdomains, where no rule fits: a parameter of ``judge``.
BLOCKED_HOSTS = tuple(f"{name}.example.{zone}" for name in ("adult-x", "cheap-pills", "free-bets", "spam-farm") for zone in ("com", "net", "org"))
#: Bits of one filter at most: 16 MB, some 40 MB as text of the plan; over 90 million listed keys at a rate of one half, 10 million at one in 500.
MAX_BITS = 1 << 27
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


@dataclass(frozen=True)
class Bloom:
    bits: int
    hashes: int
    level: int
    words: tuple[int, ...]

    def hit(self, key: Column) -> Column:
        stored = F.from_json(F.lit(json.dumps(list(self.words))), "array<bigint>")  # once in the plan, whatever the number of hashes

        def is_set(p: Column) -> Column:
            word = F.get(stored, F.floor(p / 64).cast("int"))
            return F.call_function("shiftrightunsigned", word, (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

        return F.forall(F.array(*positions(key, self.bits, self.hashes, self.level)), is_set)


def positions(key: Column, bits: int, hashes: int, level: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(hashes)]


def bloom(keys: DataFrame, n: int, rate: float, level: int) -> Bloom:
    bits = max(64, 64 * math.ceil(n * math.log2(1 / rate) / math.log(2) / 64))
    if bits > MAX_BITS:
        raise ValueError(f"{n} listed keys need {bits} bits; the bound is {MAX_BITS}")
    hashes = max(1, round(math.log2(1 / rate)))
    set_bits = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, level))).alias("p"))
    words = [0] * (bits // 64)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    for r in set_bits.groupBy(F.floor(F.col("p") / 64).cast("int").alias("at")).agg(F.bit_or(one).alias("word")).collect():
        words[r["at"]] = r["word"]
    return Bloom(bits, hashes, level, tuple(words))


@dataclass
class Cascade:
    """Exact membership over a universe: level by level, a miss ends the question."""
    levels: list[Bloom] = field(default_factory=list)

    @staticmethod
    def build(universe: DataFrame, member: str) -> Cascade:
        """``universe`` has ``key`` and the boolean column ``member``; read again at each level, so materialized."""
        within, without = universe.where(F.col(member)), universe.where(~F.col(member))
        n, others = within.count(), without.count()
        rate, made = min(0.5, max(2.0**-30, math.sqrt(0.5) * n / max(1, others))), Cascade()
        while n:
            level = bloom(within, n, rate, len(made.levels))
            made.levels.append(level)
            within, without = without.where(level.hit(F.col("key"))), within
            n, rate = within.count(), 0.5
        return made

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            out = F.when(self.levels[k].hit(key), out).otherwise(F.lit(k % 2 == 1))
        return out


@dataclass
class UrlFilter:
    shapes: list[tuple[int, int]]
    listed: Cascade
    blocked: Cascade

    @staticmethod
    def build(urls: DataFrame, rules: DataFrame, url: str = "url") -> UrlFilter:
        """``rules``: host, path, verdict (allow or block). The shapes are collected; they number at most
        the label counts times the path lengths that occur."""
        key = F.concat("host", "path").alias("key")
        shape = rules.select((F.length("host") - F.length(F.translate("host", ".", "")) + 1).alias("labels"), F.length("path").alias("chars"))
        shapes = sorted((r["labels"], r["chars"]) for r in shape.distinct().collect())
        host, path = host_and_path(F.col(url))
        keys = urls.select(host.alias("h"), path.alias("p")).distinct().select(F.explode(candidates(F.col("h"), F.col("p"), shapes)).alias("key"))
        flags = keys.distinct().select("key", F.lit(True).alias("seen"), F.lit(False).alias("listed"), F.lit(False).alias("blocked"))
        flags = flags.union(rules.select(key, F.lit(False), F.lit(True), F.col("verdict") == "block"))
        universe = materialize(flags.groupBy("key").agg(F.max("seen").alias("seen"), F.max("listed").alias("listed"), F.max("blocked").alias("blocked"))
                               .where("seen").drop("seen"), "url-keys")
        return UrlFilter(shapes, Cascade.build(universe, "listed"), Cascade.build(universe.where("listed"), "blocked"))

    def rule(self, host: Column, path: Column) -> Column:
        """The longest listed key of the url, null if none."""
        found = F.filter(candidates(host, path, self.shapes), self.listed.has)
        return F.array_max(F.transform(found, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]

    def verdict(self, rule: Column) -> Column:
        return F.when(rule.isNotNull(), F.when(self.blocked.has(rule), F.lit("block")).otherwise(F.lit("allow")))


def candidates(host: Column, path: Column, shapes: Iterable[tuple[int, int]]) -> Column:
    """The url's keys of these shapes."""
    keys = [F.when((F.length(host) > 0) & (F.length(path) >= chars) & (F.length(host) - F.length(F.translate(host, ".", "")) >= labels - 1),
                   F.concat(F.substring_index(host, ".", -labels), path.substr(1, chars))) for labels, chars in shapes]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def rules_frame(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A short list as a frame; a long one is better read from a table."""
    lines = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*lines)))


def judge(pages: DataFrame, rules: DataFrame, blocked_hosts: DataFrame, url: str = "url") -> DataFrame:
    """The rows of ``pages`` (as ``row``) with host, path, rule and verdict.

    The longest fitting rule decides; where none fits, a url whose host or
    parent domain is among ``blocked_hosts`` (same columns as ``rules``) is
    blocked and every other allowed.
    """
    by_rule, by_host = UrlFilter.build(pages, rules, url), UrlFilter.build(pages, blocked_hosts, url)
    host, path = host_and_path(F.col(url))
    split = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    split = split.withColumn("rule", by_rule.rule(F.col("host"), F.col("path")))
    own = F.when(by_host.rule(F.col("host"), F.col("path")).isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return split.withColumn("verdict", F.coalesce(by_rule.verdict(F.col("rule")), own))
