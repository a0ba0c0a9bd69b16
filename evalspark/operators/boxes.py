"""Weighted distinct points and the boxes around groups of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.features import name
from evalspark.plans.joins import skew_join


def axes(d: int, prefix: str = "x") -> list[str]:
    return [f"{prefix}{j}" for j in range(d)]


def rows_of(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """``(key, x0, x1, ..)`` of the rows that have every coordinate."""
    named = [f"cast({name(c)} as double) + 0D as {x}" for c, x in zip(columns, axes(len(columns)))]
    rows = df.selectExpr(name(key), *named)
    return rows.dropna("any")


def distinct_points(rows: DataFrame, d: int, key: str) -> DataFrame:
    """One row per distinct vector: ``(uid, w, x0, ..)``, first key and number of copies.

    Copies never meet in one task: they are counted before the shuffle.
    """
    return rows.groupBy(*axes(d)).agg(F.min(key).alias("uid"), F.count("*").alias("w"))


def spread_to_rows(rows: DataFrame, results: DataFrame, points: DataFrame, d: int, key: str) -> DataFrame:
    """Give each row the results of its vector; vectors with many copies are salted.

    ``points`` are the distinct vectors, whose copies ``w`` have been counted.
    """
    counts = points.select(*axes(d), F.col("w").alias("_rows"))
    return skew_join(rows, results, axes(d), [key], counts=counts)


# Expressions over all axes are written as SQL text: one call instead of several per axis.


def box(d: int, lo: str = "lo", hi: str = "hi") -> list[Column]:
    """Aggregates for the box around a group of points."""
    return [F.expr(f"{f}(x{j}) as {n}{j}") for j in range(d) for f, n in (("min", lo), ("max", hi))]
