"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _large_star(edges: DataFrame) -> DataFrame:
    """Point each node's larger neighbours at the least node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Point each node and its smaller neighbours at the least of them; edges run from larger u to smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Return (node, component) for every node of links whose component has a smaller node.

    links: rows (a, b) of longs, in any order; repeated links, self-links and nulls
    are ignored.  component is the smallest node reachable.  A node that is
    the smallest of its component has no row, so an empty table gives no rows.
    Every round is two shuffles of the remaining edges and its result is written to the shared
    folder; the driver sees only two sums for each round.
    """
    clean = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = stash(clean.select(F.col("u").cast("long"), F.col("v").cast("long")).distinct(), "edges")
    before = None
    while True:
        now = edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        edges = stash(_small_star(_large_star(edges)), "edges")
