"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.plans.storage import cut

# Rows of one key that a single task may take before the key is spread.
HOT_ROWS = 200_000
# Largest table sent to every executor, counted and weighed before it is sent.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes, as JSON; reads no more rows than that."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, weight = df.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
    return rows <= max_rows and (weight or 0) <= max_bytes


def hot_keys(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """Every key with more than ``hot_rows`` rows, and the number of shares to cut it in."""
    if counts is None:
        counts = df.groupBy(*on).agg(F.count("*").alias("_rows"))
    return (
        counts.filter(F.col("_rows") > hot_rows)
        .select(*on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_shares"))
    )


def skew_join(
    big: DataFrame,
    other: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``big.join(other, on, how)`` with hot keys of ``big`` cut into salted shares.

    Rows of a hot key go to a share by the hash of ``spread_by``; the matching rows
    of ``other`` are repeated once per share. Keys that are not hot get one share,
    so only the hot part of ``other`` is repeated. ``how`` is ``inner`` or ``left``.
    ``counts`` gives the rows per key as ``_rows``, where they are known already. The
    table of hot keys is broadcast if its counted size allows it, else joined by shuffle.
    """
    hot = cut(hot_keys(big, on, hot_rows, counts))
    if is_small(hot):
        hot = F.broadcast(hot)
    left = (
        big.join(hot, on, "left")
        .withColumn(
            "_salt",
            F.pmod(F.xxhash64(*spread_by), F.coalesce("_shares", F.lit(1))).cast("int"),
        )
        .drop("_shares")
    )
    right = (
        other.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)))
        .drop("_shares")
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def lookup_join(
    big: DataFrame,
    table: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    small: bool | None = None,
) -> DataFrame:
    """Join a large table to a lookup table with few rows per key.

    The lookup table is broadcast if its counted size allows it, and joined by a
    salted shuffle otherwise. It should be materialised, since counting reads it;
    a caller that has counted it already passes ``small``.
    """
    if is_small(table) if small is None else small:
        return big.join(F.broadcast(table), on, how)
    return skew_join(big, table, on, spread_by, how)
