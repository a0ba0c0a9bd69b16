"""Wide sheets with a header of several lines, exported as delimited text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METHOD_LINE, CATEGORY_LINE, INDICATOR_LINE, TITLE_LINE = 1, 2, 3, 4


def flatten_header(lines: DataFrame, n_meta: int) -> DataFrame:
    """One readable, unique name per indicator column of a sheet.

    ``lines`` holds ``line_no`` (1 = method, 2 = category, 3 = indicator) and the
    ``cells`` of that line. The first ``n_meta`` columns are metadata; columns
    without a method are blank. Returns ``(idx, name)``, 0-based.
    """
    cells = lines.filter(F.col("line_no") <= INDICATOR_LINE).select(
        "line_no", F.posexplode("cells").alias("idx", "cell")
    )

    def on(line: int):
        return F.max(F.when(F.col("line_no") == line, F.col("cell")))

    return (
        cells.filter(F.col("idx") >= n_meta)
        .groupBy("idx")
        .agg(on(METHOD_LINE).alias("method"), on(CATEGORY_LINE).alias("category"), on(INDICATOR_LINE).alias("indicator"))
        .filter(F.col("method").isNotNull())
        .select("idx", F.format_string("%s: %s [%s]", "category", "indicator", "method").alias("name"))
    )


def read_sheet(
    spark: SparkSession,
    path: str,
    meta: Sequence[tuple[int, str]],
    n_meta: int,
    required: str,
    header_lines: int = 4,
    every_file: bool = False,
) -> DataFrame:
    """Clean feature table of a text sheet: metadata columns, then named indicators.

    ``meta`` lists (position, name) of the metadata columns to keep. Rows whose
    ``required`` column is empty are dropped, numbers that are not (``nan`` among them)
    become null. The header is the top of the first file by name; only those few lines
    reach the driver, to build the schema. Header rows are told by their place, in the
    first file or, with ``every_file``, in each. Cells may hold line breaks; a file is
    one task, so a large sheet should come in several files.
    """
    rows = spark.read.option("multiLine", True).csv(path).select("*", "_metadata.file_path", F.monotonically_increasing_id().alias("_place"))
    cells = [c for c in rows.columns if c not in ("file_path", "_place")]
    starts = rows.groupBy("file_path").agg(F.min("_place").alias("_start"))  # one row per file
    first = starts.agg(F.min("file_path")).first()[0]
    placed = rows.join(starts, "file_path").withColumn("_line", F.col("_place") - F.col("_start") + 1)
    in_header = F.col("_line") <= header_lines
    of_first = F.col("file_path") == first
    empty = [F.nullif(F.col(c), F.lit("")).alias(c) for c in cells]
    head = placed.filter(in_header & of_first).select(F.col("_line").alias("line_no"), F.array(*empty).alias("cells"))
    names = flatten_header(head, n_meta).orderBy("idx").collect()  # one row per column of the sheet
    body = placed.filter(~in_header if every_file else ~(in_header & of_first)).select(*empty)

    def number(c: str) -> Column:
        x = F.col(c).try_cast("double")
        return F.when(~F.isnan(x), x)

    out = body.select(
        *[F.col(cells[i]).alias(name) for i, name in meta], *[number(cells[n["idx"]]).alias(n["name"]) for n in names]
    )
    return out.dropna(subset=[required])
