"""Connected components of a link table by alternating large and small stars.

Each round is two grouped minima with a join back; rounds end when the links stay the same, after
a number of rounds that grows with the logarithm of the longest path. Every round is written to
the shared folder. Self-links are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.session import stage


def star(pairs: DataFrame, keep: str) -> DataFrame:
    """For each u with neighbours v, and m the least of all: links (v, m) where `keep` holds."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its smallest node) of every node that has a link to another."""
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    links = stage(links, "links")
    before = mark(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, "v > u").distinct()
        # small star: u itself is linked to the least of its smaller neighbours too
        small = star(large.unionByName(large.select("u", F.col("u").alias("v"))), "v <= u").distinct()
        links = stage(small, "links")
        after = mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
