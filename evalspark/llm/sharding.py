"""Sharding by a k-d tree over metadata, in DataFrame functions alone.

A node that is to become k shards is split so that its parts, of k // 2 and of the rest,
hold their share of the bytes. The split lies along the dimension whose spread in the
node is widest, measured against its spread in the whole table, at the weighted median
(in general: the weighted quantile of that share). All nodes of a level are worked at
together: one pass finds their spreads, further passes count bytes in ``bins`` bins
around the wanted place, each time within the bin that holds it, until a bin is too
small to matter. What reaches the driver is bins, never rows.

Coordinates are made distinct by a fraction from a hash, so that a value shared by a
third of the rows is split like any other range; equal rows differ by their place in the
table written at the start.

Defined results: a null text has no bytes (size is 16, its crc32 that of nothing); null
metadata is a value of its own; repeated rows are rows of their own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.plans.storage import cut

ROWS_AT_ONCE = 50_000


def text_size(text: Column, more: int = 16) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + more


def measured(docs: DataFrame, id_col: str, text_col: str, metadata: list[str]) -> DataFrame:
    """``doc_id, size, text_crc32, x0 ...``: written out, so that later passes read no text."""
    text, kinds = F.col(text_col), 1 << 16
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        text_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        *[F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(kinds)).alias(f"m{j}") for j, c in enumerate(metadata)],
        F.monotonically_increasing_id().alias("place"),
    )

    def fraction(*by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(1 << 20)) / float(1 << 20)

    rows = rows.withColumn("tie", fraction("doc_id", "text_crc32") + fraction("place") / float(1 << 20))
    coordinates = [F.log2(F.col("size") + F.col("tie")), *[F.col(f"m{j}") + F.col("tie") for j in range(len(metadata))]]
    return cut(rows.select("doc_id", "size", "text_crc32", *[c.alias(f"x{j}") for j, c in enumerate(coordinates)]))


@dataclass
class Node:
    shards: int
    first: int
    dim: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def place(self) -> Column:
        """Number of the first shard of the leaf that a row falls into."""
        if self.low is None or self.high is None:
            return F.lit(self.first)
        return F.when(F.col(f"x{self.dim}") < self.at, self.low.place()).otherwise(self.high.place())


def grow(rows: DataFrame, shards: int, dims: int, bins: int = 1024, tolerance: float = 2e-4) -> Node:
    """The tree over coordinates ``x0 ...`` and weights ``size``."""
    root = Node(shards, 0)
    whole: dict[int, float] = {}
    level = [root]
    while level := [n for n in level if n.shards > 1]:
        within = rows.withColumn("node", root.place())
        asked = [f(f"x{j}").alias(f"{a}{j}") for j in range(dims) for a, f in (("lo", F.min), ("hi", F.max))]
        spread = {r["node"]: r for r in within.groupBy("node").agg(F.sum("size").alias("bytes"), *asked).collect()}  # one row per node
        if not whole and spread:
            whole = {j: max(r[f"hi{j}"] - r[f"lo{j}"] for r in spread.values()) or 1.0 for j in range(dims)}
        todo = {}
        for n in level:
            if r := spread.get(n.first):
                n.dim = max(range(dims), key=lambda j: (r[f"hi{j}"] - r[f"lo{j}"]) / whole[j])
                want = r["bytes"] * (n.shards // 2) / n.shards
                todo[n.first] = (n, r[f"lo{n.dim}"], r[f"hi{n.dim}"], 0.0, want, r["bytes"] * tolerance)
            else:
                n.dim = 0
        _place_splits(within, todo, bins)
        below = []
        for n in level:
            half = n.shards // 2
            n.low, n.high = Node(half, n.first), Node(n.shards - half, n.first + half)
            below += [n.low, n.high]
        level = below
    return root


def _with_bounds(within: DataFrame, todo: dict) -> DataFrame:
    """``node, size, x, low, high`` of the rows of the nodes in ``todo``."""
    if len(todo) == 1:
        [(first, (n, lo, hi, *_))] = todo.items()
        return within.filter(F.col("node") == first).select("node", "size", F.col(f"x{n.dim}").alias("x"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high"))
    asked = ", ".join(f"({first}, {n.dim}, {lo!r}D, {hi!r}D)" for first, (n, lo, hi, *_) in todo.items())
    bounds = within.sparkSession.sql(f"SELECT * FROM VALUES {asked} AS t(node, dim, low, high)")  # a row per node of a level
    x = F.array(*[c for c in within.columns if re.fullmatch(r"x\d+", c)])[F.col("dim")]
    return within.join(F.broadcast(bounds), "node").select("node", "size", x.alias("x"), "low", "high")


def _place_splits(within: DataFrame, todo: dict, bins: int) -> None:
    """Set ``at`` of each node: the border between bins closest to the wanted weight below it.

    A value of ``todo`` has the node, the interval that holds the border, the weight below
    that interval, the wanted weight, and the weight of a bin that need not be cut further.
    """
    while todo:
        place = F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins)
        counted = (
            _with_bounds(within, todo)
            .filter(F.col("x").between(F.col("low"), F.col("high")))
            .groupBy("node", F.when(F.col("high") > F.col("low"), place).otherwise(0).alias("bin"))
            .agg(F.sum("size").alias("bytes"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .orderBy("node", "bin")
            .collect()  # at most bins + 1 for each node of a level
        )
        by_node: dict[int, list] = {}
        for r in counted:
            by_node.setdefault(r["node"], []).append(r)
        for first in list(todo):
            n, lo, hi, below, want, least = todo[first]
            for r in by_node[first][:-1]:
                if below + r["bytes"] > want:
                    break
                below += r["bytes"]
            else:
                r = by_node[first][-1]
            if r["bytes"] > least and (r["lo"], r["hi"]) != (lo, hi) and r["lo"] < r["hi"]:
                todo[first] = (n, r["lo"], r["hi"], below, want, least)
                continue
            behind = below + r["bytes"] - want < want - below  # the border behind the bin is closer than that before it
            n.at = math.nextafter(r["hi"], math.inf) if behind else r["lo"]
            del todo[first]


def numbered(rows: DataFrame, shard: str, slot: str) -> DataFrame:
    """Add a number per shard, gapless from 0, in pieces of about ``ROWS_AT_ONCE`` rows.

    A shard is dealt into pieces by a hash, so that none is numbered by a single task;
    each piece starts where those before it end.
    """
    largest = rows.groupBy(shard).count().agg(F.max("count")).first()[0] or 0
    pieces = max(1, -(-largest // ROWS_AT_ONCE))
    dealt = cut(rows.withColumn("_piece", F.pmod(F.xxhash64("doc_id", "text_crc32", "x0"), F.lit(pieces)).cast("int")))
    sizes = dealt.groupBy(shard, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_piece").orderBy("doc_id", "text_crc32", "x0")
    placed = dealt.withColumn("_row", F.row_number().over(within) - 1)
    return placed.join(starts, [shard, "_piece"]).withColumn(slot, (F.col("_start") + F.col("_row")).cast("long")).drop("_piece", "_row", "_start")


def shard(docs: DataFrame, id_col: str, text_col: str, metadata: list[str], shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: shards of nearly equal bytes."""
    rows = measured(docs, id_col, text_col, metadata)
    tree = grow(rows, shards, 1 + len(metadata))
    return numbered(rows.withColumn("shard", tree.place().cast("int")), "shard", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def shards_for(docs: DataFrame, text_col: str, target_bytes: int) -> int:
    """How many shards of ``target_bytes`` the table makes."""
    total = docs.agg(F.sum(text_size(F.col(text_col)))).first()[0] or 0
    return max(1, -(-total // target_bytes))
