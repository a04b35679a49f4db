"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmask.llm.blocks import settle


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the lowest of u and its partners; minima are combined before the shuffle."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    star = _lowest(down)
    moved = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(star.where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every linked node u other than its component's lowest node v.

    Rounds are checkpointed; the loop ends when a round changes nothing, after about the
    logarithm of the longest chain of links.  No links: an empty result."""
    now = settle(_small_star(settle(edges.where("u <> v").select("u", "v"))))
    before = _state(now)
    while before[0]:
        now = settle(_small_star(_large_star(now)))
        after = _state(now)
        if after == before:
            break
        before = after
    return now
