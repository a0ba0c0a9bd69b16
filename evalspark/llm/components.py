"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.plans.storage import cut


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` for each end of the links ``(a, b)``; the component is its smallest node.

    Alternating star contraction: each node hangs its larger neighbours on its smallest
    one, then its smaller ones, until every link points at the smallest node of its
    component. The number of links never grows, the number of rounds follows the
    logarithm of the longest path, and each round goes on from a written table.
    """
    now = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _print(now)
    for _ in range(rounds):
        if seen[0] == 0:
            break
        now = _small_star(_large_star(now))
        now = cut(now)
        last, seen = seen, _print(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"the components have not settled after {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _print(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Of each node, link the larger neighbours to the smallest of it and its neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Of each node, link its smaller neighbours and itself to the smallest of them."""
    turned = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = turned.groupBy("a").agg(F.min("b").alias("m"))
    others = turned.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
