"""Stores keyed by case id: JSON maps on disk, long tables in Spark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Cases per stored JSON object; one object is written and read by one task.
CASES_PER_OBJECT = 1_000


def read_store(
    spark: SparkSession, path: str, models: Sequence[str], suffix: str = "_raw", whole_file: bool = False
) -> DataFrame:
    """Long table ``(case_id, model, raw)`` of a store of JSON objects keyed by case id.

    A store folder holds files with one object per line; ``whole_file`` reads files
    whose single object spans several lines. A JSON object cannot be split, so it
    is one task's work: write many objects of bounded size, as ``write_store`` does,
    and keep the long table from then on.
    """
    fields = ", ".join(f"`{m}{suffix}`: string" for m in models)
    objects = spark.read.text(path, wholetext=whole_file)
    cases = objects.select(
        F.explode(F.from_json("value", f"map<string, struct<{fields}>>")).alias("case_id", "case")
    ).select(F.col("case_id").cast("long").alias("case_id"), "case.*")
    return melt_models(cases, ["case_id"], models, suffix)


def write_store(wide: DataFrame, path: str, key: str = "case_id", cases_per_object: int = CASES_PER_OBJECT) -> None:
    """Write a wide store (one row per case) as lines of JSON objects keyed by case id."""
    n = wide.agg(F.ceil(F.count("*") / cases_per_object)).first()[0]
    entry = F.struct(F.col(key).cast("string").alias("k"), F.struct(*[c for c in wide.columns if c != key]).alias("v"))
    (
        wide.groupBy(F.pmod(F.xxhash64(key), F.lit(max(1, n))).alias("shard"))
        .agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
        .select("value")
        .write.text(path)
    )


def melt_models(df: DataFrame, ids: Sequence[str], models: Sequence[str], suffix: str = "_raw") -> DataFrame:
    """One row per case and model from one column per model."""
    named = df.select(*ids, *[F.col(f"`{m}{suffix}`").alias(m) for m in models])
    return named.unpivot(list(ids), list(models), "model", suffix.lstrip("_"))


def spread_models(df: DataFrame, ids: Sequence[str], models: Sequence[str], value: str, suffix: str = "_raw") -> DataFrame:
    """One column per model from one row per case and model."""
    wide = df.groupBy(*ids).pivot("model", list(models)).agg(F.first(value, ignorenulls=True))
    return wide.select(*ids, *[F.col(f"`{m}`").alias(f"{m}{suffix}") for m in models])


def label_models(df: DataFrame, names: Mapping[str, str], column: str = "model", out: str = "model_name") -> DataFrame:
    """Add the display name of each model; a model without one keeps its key."""
    table = F.create_map(*[F.lit(v) for item in names.items() for v in item])
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))
