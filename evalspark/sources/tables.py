"""Tables: scans with renaming, written tables, reports and read-back checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: Mapping[str, str], fmt: str = "parquet") -> DataFrame:
    """Read only the given columns and give them new names (``{source: name}``)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path).select(*[F.col(f"`{c}`").alias(name) for c, name in columns.items()])


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose key fields are all present."""
    return df.dropna(subset=list(columns))


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Write a table once as Parquet and return the scan of it for later jobs."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_report(df: DataFrame, path: str) -> DataFrame:
    """Write a report as CSV with a header and return the scan of it."""
    df.write.option("header", True).option("emptyValue", '""').csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def write_cases(cases: DataFrame, path: str) -> None:
    """Write test cases with their nested truth, one JSON object per line."""
    cases.write.json(path)


CASE_SCHEMA = (
    "id long, activity_uuid string, description string, ground_truth struct<activity_name string, "
    "geography string, reference_product_name string, reference_product_unit string>, batch string"
)


def read_cases(spark: SparkSession, path: str, schema: str = CASE_SCHEMA, multi_line: bool = False) -> DataFrame:
    """Read test cases. ``multi_line`` is for files that hold one pretty-printed list."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def verify_sink(df: DataFrame, path: str, group: str) -> DataFrame:
    """Compare a table with what was written of it: rows, columns, rows per group.

    Returns ``(check, written, expected, ok)``. The tables are reduced to counts
    before they meet.
    """
    back = df.sparkSession.read.parquet(path)

    def counts(x: DataFrame, name: str) -> DataFrame:
        return x.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("null")).alias("g")).agg(
            F.count("*").alias(name)
        )

    groups = counts(back, "written").join(counts(df, "expected"), "g", "full").select(
        F.concat(F.lit(f"rows where {group} = "), "g").alias("check"),
        F.coalesce("written", F.lit(0)).cast("long").alias("written"),
        F.coalesce("expected", F.lit(0)).cast("long").alias("expected"),
    )
    rows = groups.agg(
        F.lit("rows").alias("check"),
        F.coalesce(F.sum("written"), F.lit(0)).cast("long").alias("written"),
        F.coalesce(F.sum("expected"), F.lit(0)).cast("long").alias("expected"),
    )
    same = sum(1 for f in df.schema if f.name in back.columns and back.schema[f.name].dataType == f.dataType)
    shape = df.sparkSession.range(1).select(
        F.lit("columns of the same type").alias("check"),
        F.lit(same).cast("long").alias("written"),
        F.lit(len(df.columns)).cast("long").alias("expected"),
    )
    return groups.unionByName(rows).unionByName(shape).withColumn("ok", F.col("written") == F.col("expected"))


def summary_document(facts: DataFrame, by: Sequence[str], name: str, value: str, document: str = "document") -> DataFrame:
    """Nested summary from tidy facts: per group a JSON object of name to value.

    Facts are one row per result (model x field), so a group holds as many entries
    as there are result names, whatever the size of the data behind them.
    """
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value))))
    return facts.groupBy(*by).agg(F.to_json(entries).alias(document))


def nested_report(spark: SparkSession, sections: Mapping[str, DataFrame], document: str = "document") -> DataFrame:
    """One JSON document of several result tables: ``(document)``, one row.

    A section whose name ends in ``!`` has one row and becomes a value or an object. Two
    columns become a map of the first to the second, three a map of maps, and more a
    list of objects in order. Results are a few rows each, whatever they were made from.
    """

    def entries(key: str, value: Column) -> Column:
        return F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), value.alias("v"))))

    parts = []
    for name, df in sections.items():
        c = df.columns
        if name.endswith("!"):  # a single row
            whole = df.select(F.col(c[0]) if len(c) == 1 else F.struct(*c))
        elif len(c) == 2:
            whole = df.agg(F.map_from_entries(entries(c[0], F.col(c[1]))))
        elif len(c) == 3:
            inner = df.groupBy(c[0]).agg(entries(c[1], F.col(c[2])).alias("_inner"))
            listed = F.transform(entries(c[0], F.col("_inner")), lambda e: F.struct(e["k"], F.map_from_entries(e["v"])))
            whole = inner.agg(F.map_from_entries(listed))
        else:
            whole = df.agg(F.array_sort(F.collect_list(F.struct(*c))))
        parts.append(whole.scalar().alias(name.rstrip("!")))
    return spark.range(1).select(F.to_json(F.struct(*parts)).alias(document))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def as_double(column: str) -> Column:
    """Number in a text or numeric column; anything else, and NaN, is null."""
    value = F.col(f"`{column}`").try_cast("double")
    return F.when(F.isnan(value), None).otherwise(value)
