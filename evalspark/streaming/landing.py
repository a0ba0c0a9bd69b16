"""Incremental landing of answer files into a long store, safe to stop and resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalspark.operators.store import parse_answers
from evalspark.plans.storage import new_folder
from evalspark.sources.buckets import BucketStore

ANSWER_SCHEMA = "case_id long, model string, raw string, version long"


def land_stream(
    spark: SparkSession, landing: str, store: str, checkpoint: str, fields: Sequence[str], schema: str = ANSWER_SCHEMA,
    files_per_batch: int = 1_000,
) -> StreamingQuery:
    """Parse every new answer file once and append it to the store as Parquet.

    Each micro-batch is written to a folder of its own number with overwrite, so a
    batch that is run again after a failure replaces itself. The query handles all
    files present, so many to a batch, and ends; the next call takes up from the checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        parse_answers(batch, fields).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(landing)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _landed(spark: SparkSession, store: str, after: int = -1) -> DataFrame:
    return spark.read.option("basePath", store).parquet(store).withColumn("batch", F.col("batch").cast("long")).filter(F.col("batch") > after)


def compact(spark: SparkSession, store: str, compacted: str, keys: Sequence[str] = ("case_id", "model"), buckets: int = 64) -> BucketStore:
    """Move the batches landed so far into a store of hash buckets, made if it isn't there.

    The store remembers the last batch it has taken in, so a run that failed or is repeated
    adds nothing twice, and readers stop reading the batches it holds.
    """
    try:
        target = BucketStore(spark, compacted)
    except AnalysisException:
        target = BucketStore.create(spark, compacted, _landed(spark, store).schema, keys, buckets)
    done = target.manifest()[1]
    new = _landed(spark, store, done)
    last = new.agg(F.max("batch")).first()[0]
    if last is not None:
        target.upsert(new.filter(F.col("batch") <= last), order=["version", "batch"], batch=last)
    return target


def latest(
    spark: SparkSession, store: str, keys: Sequence[str] = ("case_id", "model"), compacted: BucketStore | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Newest answer per case and model; a failed try never hides an earlier answer.

    Where batches have been ``compacted``, only later ones are read one by one. ``max_by``
    combines on the map side, so nothing is gathered per key; but it sorts its rows, so name
    the ``columns`` wanted beside the keys where texts and parsed fields are not.
    """
    landed = _landed(spark, store, -1 if compacted is None else compacted.manifest()[1])
    if compacted is not None:
        landed = landed.unionByName(compacted.read())
    if columns is None:
        columns = [c for c in landed.columns if c not in (*keys, "version", "batch")]
    # Worked out before the aggregate, so that the text itself is sorted only where it is wanted.
    rank = F.struct(F.col("raw").isNotNull(), F.col("version"), F.col("batch"))
    ranked = landed.select(*keys, F.struct(*columns).alias("row"), rank.alias("_rank"))
    return ranked.groupBy(*keys).agg(F.max_by("row", "_rank").alias("row")).select(*keys, "row.*")


def land_twice(answers: DataFrame, fields: Sequence[str], compacting: bool = False) -> DataFrame:
    """Land answers in two runs with one checkpoint and count the states in the store.

    The second run repeats half of the first run's answers, which must not count twice.
    ``compacting`` moves the first run's batch into buckets before the second one lands.
    """
    spark = answers.sparkSession
    root = new_folder(spark, "landing")
    half = F.col("case_id") % 2
    target = None
    for run, batch in enumerate([answers.filter(half == 0), answers]):
        files = batch.withColumn("version", F.lit(run).cast("long"))
        files.write.mode("append").json(f"{root}/in")
        land_stream(spark, f"{root}/in", f"{root}/store", f"{root}/state", fields).awaitTermination()
        if compacting and run == 0:
            target = compact(spark, f"{root}/store", f"{root}/compacted")
    states = latest(spark, f"{root}/store", compacted=target, columns=["parse_state"])
    return states.groupBy("model", "parse_state").agg(F.count("*").alias("n"))
