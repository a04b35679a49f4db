"""URL rules by exact Bloom filter cascades; DataFrame functions only.

A rule is a host and a path prefix (``example.net/en/``); it fits its host and all
subdomains if the url's path starts with its path.  So the keys a url could be listed under
are its host's suffixes, each followed by a prefix of its path, of the lengths that rules
have.  The key universe is all such keys of the whole corpus.

One cascade per list: level 1 encodes the listed keys, level 2 the keys of the universe that
level 1 takes for listed, level 3 the listed keys that level 2 takes for those, and so on
until a level errs on no key; then membership is exact for every key of the corpus, and a
url is judged from a few bit arrays, without a join.  Level 1 has about
log2(universe / list) bits a listed key, so all levels together are bounded by the list's
size times that logarithm; they reach the tasks as scalar subqueries.  Joins and shuffles
occur only while levels are built, over distinct keys.

The longest listed key decides; equal lengths: the first in code-point order.  A url without
a listed key gets the cascades' verdict: not listed, so allowed.  Null urls and urls without
``://`` have an empty host and path.  Repeated rows are judged each; empty tables, empty
lists and empty universes give cascades without levels, which list nothing.  Columns of the
input named like an output are replaced, others pass through whatever their names.

A level's bit array is one value made by one task: some 10 to 40 bits a listed key, so lists of
some hundred million keys (a few hundred MB) are the most it is meant for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmask.llm.blocks import settle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEEDS_PER_LEVEL = 64


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(key, verdict) of rules given as (verdict, 'host/path')."""
    return spark.createDataFrame([(r, v) for v, r in rules], "key string, verdict string")


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Distinct host suffixes, each with the path's prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))


class Level:
    """One Bloom filter: ``bits`` positions, ``hashes`` per key, the words of its bit array."""

    def __init__(self, number: int, keys: int, error: float):
        self.hashes = max(1, round(math.log2(1 / error)))
        self.bits = 64 * max(1, math.ceil(keys * self.hashes / math.log(2) / 64))
        self.seed = number * _SEEDS_PER_LEVEL
        self.words: DataFrame | None = None

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.seed + i), key), F.lit(self.bits)) for i in range(self.hashes)]

    def encode(self, keys: DataFrame) -> Level:
        spark = keys.sparkSession
        set_bits = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("at"))
        words = set_bits.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("value"))
        every = spark.range(self.bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
        one = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("value", F.lit(0)).alias("value")))).alias("all"))
        self.words = settle(one.select(F.transform("all", lambda x: x["value"]).alias("words")))
        return self

    def holds(self, words: Column, key: Column) -> Column:
        """Whether the filter takes the key for one of its own."""
        out = F.lit(True)
        for at in self.positions(key):
            out = out & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return out


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def attach(self, df: DataFrame, name: str) -> DataFrame:
        for i, level in enumerate(self.levels):
            df = df.withColumn(f"{name}{i}", level.words.scalar())
        return df

    def lists(self, key: Column, name: str) -> Column:
        """Exact membership of a key of the universe; needs the columns that attach() adds."""
        listed = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            # a key that level i does not hold is on the other side of what it encodes
            listed = F.when(self.levels[i].holds(F.col(f"{name}{i}"), key), listed).otherwise(F.lit(i % 2 == 1))
        return listed


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the distinct ``key``s of ``listed`` over those of ``universe``."""
    ours = settle(listed.select("key").distinct())
    others = universe.select("key").distinct().join(ours, "key", "left_anti")
    n, levels = ours.count(), []
    if not n:
        return Cascade(levels)
    all_keys = max(1, universe.agg(F.approx_count_distinct("key")).first()[0])
    held, against, error = ours, others, min(0.5, math.sqrt(0.5) * n / all_keys)
    while True:
        level = Level(len(levels), n, error).encode(held)
        levels.append(level)
        wrong = against.withColumn("w", level.words.scalar()).where(level.holds(F.col("w"), F.col("key"))).select("key")
        wrong = settle(wrong)
        n = wrong.count()
        if not n:
            return Cascade(levels)
        held, against, error = wrong, held, 0.5


def _fitting(cascade: Cascade, name: str, verdict: str) -> Column:
    """The row's keys that the cascade lists, so that the longest sorts first."""
    listed = F.filter("_keys", lambda k: cascade.lists(k, name))
    return F.transform(listed, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key"), F.lit(verdict).alias("verdict")))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_column: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the fitting one that wins, else null) and
    ``verdict``; columns of the input named so are replaced."""
    spark, own = pages.sparkSession, ("host", "path", "rule", "verdict")
    lengths = sorted({len(r) - len(r.split("/", 1)[0]) for _, r in rules})
    # the row apart, so that no column of it meets those that are made here
    url = F.col(f"`{url_column}`")
    parsed = pages.select(F.struct("*").alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    universe = settle(parsed.select("host", "path").distinct().select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key")).distinct())
    table = rule_table(spark, rules)
    verdicts = sorted({v for v, _ in rules})
    parsed = parsed.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    fits = []
    for v in verdicts:
        cascade, name = build(table.where(F.col("verdict") == v), universe), f"_{v}"
        parsed = cascade.attach(parsed, name)
        fits.append(_fitting(cascade, name, v))
    best = F.array_min(F.concat(*fits)) if fits else F.lit(None).cast("struct<n:int,key:string,verdict:string>")
    kept = [F.col(f"row.`{c}`").alias(c) for c in pages.columns if c not in own]
    out = parsed.withColumn("_best", best)
    return out.select(*kept, "host", "path", F.col("_best.key").alias("rule"), F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"))
