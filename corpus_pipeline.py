"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on what the one before kept. All but
the last return the columns of ``documents``; ``run`` writes each result as Parquet to
the shared folder and reads it for the next.

1. ``language``: drops documents whose language can't be told (no text, or no letters).
2. ``quality``: drops documents that fail the base rules or that the rules' votes make
   far more probably bad than good.
3. ``near_duplicates``: keeps one document of each group of the SimHash operator (three-word
   shingles, three bits), that of the smallest id (of rows with that id, the first).
4. ``secrets``: puts a mark in place of each secret and sets ``n_chars`` to the new length.
5. ``packing``: one row per piece of a document in a training sequence; the first line of a text
   of several lines is its prompt and bears no loss.

Nulls, empty texts, repeated rows, empty tables and further columns are treated as each
operator states; further columns pass through the first four stages.

Each stage bounds the bytes of the Arrow batches that reach Python (``bounded_batches``), a
setting of the session, as a stage's result is computed when it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import langid, packing, quality, secret_scan, simhash
from evalspark.llm.common import bounded_batches, fresh, table
from evalspark.plans.storage import cut, new_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    answer = fresh(docs, "_answer")
    model = langid.train(docs, "doc_id", "text", "lang")
    told = docs.withColumn(answer, langid.predicted(F.col("text"), model))
    return told.filter(F.col(f"{answer}.lang_pred") != "und").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    counts, whole = fresh(docs, "_counts"), fresh(docs, "_whole")
    voted = cut(quality.votes(docs.select(F.struct(*docs.columns).alias(whole), quality.features(F.col("text")).alias(counts)).select(whole, f"{counts}.*")))
    kept = quality.judge(voted, quality.fit(voted)).filter("kept")
    return kept.select(f"{whole}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    row = F.monotonically_increasing_id().alias("row")
    marked = cut(docs.select(F.struct(*docs.columns).alias("whole"), simhash.fingerprint(F.col("text")).alias("f"), row))
    best = F.min(F.struct(F.col("whole.doc_id").isNull().alias("none"), F.col("whole.doc_id").alias("doc_id"), "row")).alias("first")
    copies = cut(marked.groupBy("f").agg(best))  # copies meet here, before anything is joined
    first = copies.join(simhash.fingerprint_groups(copies), "f").groupBy("component").agg(F.min("first").alias("first")).select("first.row")
    return marked.join(first, "row", "left_semi").select("whole.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    model = secret_scan.learn(docs, "text")
    whole = cut(docs.select(F.struct(*docs.columns).alias("whole"), secret_scan.scan(F.col("text"), model).alias("r")).select("whole", "r.*"))
    found = secret_scan.with_spans(whole, secret_scan.thresholds(whole))
    has = F.size("found") > 0
    clean = found.withColumn("clean", secret_scan.redacted(F.when(has, F.col("whole.text")), F.when(has, F.col("found"))))
    new = {"text": F.coalesce("clean", "whole.text")}
    if "n_chars" in docs.columns:
        length = F.length("clean").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("clean").isNull(), F.col("whole.n_chars")).otherwise(length)
    return clean.select(*[new.get(c, F.col("whole")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(docs, "doc_id", "text", packing.TRAINING, prompt_text=packing.heading(F.col("text")))


STAGES = [
    ("language", language),
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", pack),
]

ORACLE_SQL = None  # models and estimates aren't SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
