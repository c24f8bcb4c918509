"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _star(pairs: DataFrame) -> DataFrame:
    """Each ``far`` of a ``node`` linked to the least of the node and its ``far``."""
    least = pairs.groupBy("node").agg(F.min("far").alias("m"))
    return pairs.join(least.select("node", F.least("node", "m").alias("m")), "node")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``: the least node that links reach.

    A hub's links are folded by a partial minimum before the shuffle, and the join back to the minimum is
    one that adaptive execution splits. Every round is checkpointed; the number of rounds grows with the
    logarithm of the longest chain. Null ends and self links are left out.
    """
    whole = edges.filter("a is not null and b is not null and a <> b")
    links = whole.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct().checkpoint()
    state = None
    while state != (now := _state(links)):
        state = now
        both = links.select(F.col("hi").alias("node"), F.col("lo").alias("far")).unionByName(
            links.select(F.col("lo").alias("node"), F.col("hi").alias("far"))
        )
        large = _star(both).filter("far > node").select(F.col("far").alias("node"), F.col("m").alias("far")).distinct()
        star = _star(large)
        small = star.select(F.col("node").alias("hi"), F.col("m").alias("lo")).unionByName(
            star.filter("far <> m").select(F.col("far").alias("hi"), F.col("m").alias("lo"))
        )
        links = small.distinct().checkpoint()
    members = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return members.unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
