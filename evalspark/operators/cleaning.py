"""Numeric cleaning, missingness, column choice and exact duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.sources.tables import as_double


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn columns into doubles; text that is no number, and NaN, becomes null."""
    return df.withColumns({c: as_double(c) for c in columns})


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in every column. Row keys stay as they are."""
    return df.dropna("any", subset=list(columns))


def _missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_rows, n_missing) from one pass over the table."""
    counted = df.agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]
    )
    return counted.unpivot(["n_rows"], [F.col(f"`{c}`") for c in columns], "column", "n_missing")


def missing_overall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of cells, of missing cells, and their share in percent."""
    return _missing_counts(df, columns).agg(
        F.sum("n_rows").alias("total_cells"),
        F.sum("n_missing").alias("missing_cells"),
        F.try_divide(100.0 * F.sum("n_missing"), F.sum("n_rows")).alias("pct_missing"),
    )


def missing_by_column(df: DataFrame, columns: Sequence[str], n: int | None = None, most: bool = True) -> DataFrame:
    """Missing cells per column, most first; ``n`` keeps the n most or least missing."""
    report = _missing_counts(df, columns).select(
        "column", "n_missing", F.try_divide(100.0 * F.col("n_missing"), F.col("n_rows")).alias("pct_missing")
    )
    if n is None:
        return report.orderBy(F.desc("n_missing"), "column")
    return report.orderBy(F.desc("n_missing") if most else F.asc("n_missing"), "column").limit(n)


def key_phrase(name):
    """Middle part of ``category: indicator [method]``, used to look for near names."""
    return F.trim(F.split(F.split(name, ":")[1], r"\[")[0])


# Characters of a phrase that names are looked up by.
PIECE = 4


def representative_candidates(available: DataFrame, targets: DataFrame, n: int = 3) -> DataFrame:
    """For each wanted column name: itself if available, else up to ``n`` near names.

    ``available`` is ``(idx, name)`` in table order, ``targets`` is ``(target)``. Both
    are column dictionaries. Returns ``(target, found, rank, name)``; ``name`` is
    null if nothing is near.
    """
    from pyspark.sql import Window

    wanted = targets.select("target", key_phrase(F.col("target")).alias("phrase"))
    hit = wanted.join(available, F.col("target") == F.col("name"), "left").select("target", "phrase", "name")
    found = hit.filter(F.col("name").isNotNull()).select(
        "target", F.lit(True).alias("found"), F.lit(1).alias("rank"), "name"
    )
    missed = hit.filter(F.col("name").isNull()).drop("name")
    by_position = Window.partitionBy("target").orderBy("idx")
    # A name that holds the phrase has the phrase's first letters at some place: an equality join finds it.
    size = F.least(F.length("phrase"), F.lit(PIECE))
    asked = missed.withColumn("piece", F.substring(F.col("phrase"), F.lit(1), size))
    places = F.sequence(F.lit(1), F.length("name") + 1)

    def pieces(n: int):
        return F.transform(places, lambda i: F.substring(F.col("name"), i, F.lit(n)))

    every = F.array_distinct(F.concat(*[pieces(n) for n in range(PIECE + 1)]))
    by_piece = available.select("idx", "name", F.explode(every).alias("piece"))
    held = asked.join(by_piece, "piece").filter(F.col("name").contains(F.col("phrase"))).select("target", "idx", "name")
    near = (
        missed.join(held, "target", "left")
        .withColumn("rank", F.row_number().over(by_position))
        .filter(F.col("rank") <= n)
        .select("target", F.lit(False).alias("found"), "rank", "name")
    )
    return found.unionByName(near)


def select_representative(df: DataFrame, meta: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Metadata columns and those wanted columns that the table has, in wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in [*meta, *[t for t in targets if t in df.columns]]])


def duplicate_flags(df: DataFrame, columns: Sequence[str], key: str = "row_id") -> DataFrame:
    """``(key, is_duplicate)``: true for rows after the first with the same values.

    The first row of each vector comes from a partial aggregate, so a vector that
    fills much of the table is never gathered in one task.
    """
    first = df.groupBy(*columns).agg(F.min(key).alias(key)).select(key, F.lit(False).alias("is_duplicate"))
    return df.select(key).join(first, key, "left").withColumn(
        "is_duplicate", F.coalesce("is_duplicate", F.lit(True))
    )


def duplicate_excess(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, rows beyond the first of each distinct vector, and their percentage."""
    return (
        df.groupBy(*columns)
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_excess"))
        .withColumn("pct_excess", F.try_divide(100.0 * F.col("n_excess"), F.col("n_rows")))
    )
