"""What the operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = 4 << 20  # of a table that Python reads at a time
BATCH_ROWS = 512  # that Spark decodes from Parquet at a time


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Have rows reach Python in Arrow batches of about ``most`` bytes at the most.

    By default 10,000 texts, up to 64 MB, make one batch, which each running task holds several
    times: as Arrow in the JVM and in Python, as strings, and once more while a buffer doubles.
    For the same reason Spark decodes fewer rows of Parquet at a time: the texts of 4,096 are one array
    that grows by doubling. Smaller bounds of the session stay.
    """
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(rows, str(min(BATCH_ROWS, int(spark.conf.get(rows)))))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", spark.conf.get(name).lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= most:
        spark.conf.set(name, str(most))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def portions(items: Iterable, weight, most: int) -> Iterator[list]:
    """Consecutive lists of items whose weights sum to about ``most`` at the most."""
    part: list = []
    total = 0
    for item in items:
        w = weight(item)
        if part and total + w > most:
            yield part
            part, total = [], 0
        part.append(item)
        total += w
    if part:
        yield part
