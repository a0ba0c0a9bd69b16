"""Shared storage of a job: lineage cuts and folders for written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A folder of our own is made only where the session names none and runs in one
    process, as in tests. On a cluster a local folder would lose rows, so that is an
    error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master or 'the cluster'} share")
        folder = tempfile.mkdtemp(prefix="evalspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder below the shared one that nothing has used yet."""
    return f"{shared_dir(spark)}/evalspark/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    The table outlives the executors that computed it and drops the lineage. Unlike
    a checkpoint it is columnar, has a known size, so that small tables are
    broadcast on that evidence, and leaves the optimizer no constraints to carry
    from round to round of an iteration.
    """
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def use_all_cores(df: DataFrame, most: int = 64, by_files: bool = False) -> DataFrame:
    """Deal the rows of a small scan out over the cores.

    A file of one row group is read by one task, whatever is done to its rows. A
    scan that already has as many tasks is left as it is; ``by_files`` goes by the number of
    files too, as of a file's splits only those with the middle of a row group have rows. For
    plain scans only: asking for the number of tasks would run the stages of anything else.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, most)
    tasks = df.rdd.getNumPartitions()
    # Splits of full size, several to a core, are taken to be row groups.
    dealt = tasks >= wanted and (not by_files or tasks >= 4 * wanted or len(df.inputFiles()) >= wanted)
    return df if dealt else df.repartition(wanted)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by ``keys`` into as many tasks as the session shuffles into.

    For joins that are small in bytes but long to compute: adaptive execution would
    merge their partitions into a few, which it does not do to a number asked for.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
