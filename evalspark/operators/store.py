"""Answer stores as long tables: parsing, reuse, pending work, repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions import answers as A


def parse_answers(store: DataFrame, fields: Sequence[str], raw: str = "raw") -> DataFrame:
    """Add ``parse_state`` and the struct ``parsed``; null or empty text is an error."""
    read = store.withColumn("_answer", A.read_answer(F.col(raw), fields))
    return read.withColumns({"parse_state": F.col("_answer.state"), "parsed": F.col("_answer.parsed")}).drop("_answer")


def reuse_answers(work: DataFrame, earlier: DataFrame, models: Sequence[str], keys: Sequence[str] = ("activity_uuid", "model")) -> DataFrame:
    """Fill open answers from an earlier run of the same record and model.

    Only the named models may be reused, and only non-empty answers. ``origin``
    tells where the answer came from: kept, reused or open.
    """
    old = earlier.filter(F.col("model").isin(list(models)) & (F.coalesce("raw", F.lit("")) != "")).select(
        *keys, F.col("raw").alias("_old")
    )
    joined = work.join(old, list(keys), "left")
    origin = F.when(F.col("raw").isNotNull(), "kept").when(F.col("_old").isNotNull(), "reused").otherwise("open")
    return joined.withColumn("origin", origin).withColumn("raw", F.coalesce("raw", "_old")).drop("_old")


def _answered(store: DataFrame, empty_is_missing: bool):
    raw = F.col("raw")
    return raw.isNotNull() & (raw != "") if empty_is_missing else raw.isNotNull()


def pending(cases: DataFrame, models: Sequence[str], store: DataFrame, key: str = "case_id", empty_is_missing: bool = False) -> DataFrame:
    """Pairs of case and model without an answer."""
    wanted = cases.select(key, F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    done = store.filter(_answered(store, empty_is_missing)).select(key, "model")
    return wanted.join(done, [key, "model"], "left_anti")


def complete(store: DataFrame, models: Sequence[str], key: str = "case_id", empty_is_missing: bool = False) -> DataFrame:
    """Per case the number of answered models and whether all of them are."""
    wanted = F.col("model").isin(list(models))
    answered = F.when(wanted & _answered(store, empty_is_missing), F.col("model"))
    per_model = store.groupBy(key, "model").agg(F.max(answered).alias("answered"))
    return per_model.groupBy(key).agg(F.count("answered").alias("n_answered")).withColumn(
        "complete", F.col("n_answered") == len(set(models))
    )


def gaps(store: DataFrame, model: str, key: str = "case_id", empty_is_missing: bool = True) -> DataFrame:
    """Cases of one model that need another try, in order of their id."""
    return store.filter((F.col("model") == model) & ~_answered(store, empty_is_missing)).select(key).orderBy(key)


def upsert(store: DataFrame, patch: DataFrame, keys: Sequence[str] = ("case_id", "model")) -> DataFrame:
    """Put new answers into the store; a failed (null) patch leaves the old answer."""
    new = patch.select(*keys, F.col("raw").alias("_new"))
    return store.select(*keys, "raw").join(new, list(keys), "full").select(
        *keys, F.coalesce("_new", "raw").alias("raw")
    )
