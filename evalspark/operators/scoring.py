"""Scores of parsed answers against the truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.answers import OK, PARSE_ERROR
from evalspark.functions.text import normalize


def right(field: str, require_nonempty: bool = False) -> Column:
    """Whether a parsed field equals the true one after normalising both."""
    said, true = normalize(F.col("parsed")[field]), normalize(F.col("ground_truth")[field])
    same = said == true
    if require_nonempty:
        same = same & (said != "")
    return F.coalesce((F.col("parse_state") == OK) & same, F.lit(False))


def field_correct(scored: DataFrame, fields: Sequence[str], require_nonempty: bool = False) -> DataFrame:
    """One 0/1 column per field, named after it with ``_correct``, and ``correct`` for all.

    ``scored`` has ``parse_state``, ``parsed`` and ``ground_truth``. An answer that
    could not be parsed is wrong in every field but stays in the count.
    """
    flags = {f"{f}_correct": right(f, require_nonempty).cast("int") for f in fields}
    out = scored.withColumns(flags)
    return out.withColumn("correct", F.least(*[F.col(c) for c in flags]) if len(flags) > 1 else F.col(*flags))


def parse_failures(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return scored.groupBy(*by).agg(F.count_if(F.col("parse_state") == PARSE_ERROR).alias("parse_failures"))


def _rate(count: str, total: str = "n_cases") -> dict[str, Column]:
    exact = F.try_divide(F.col(count), F.col(total))
    return {"accuracy": exact, "accuracy_pct": F.round(100.0 * exact, 1)}


def _n_cases(cases: DataFrame | None) -> Column:
    """Rows of a group, or the number of all cases, answered or not."""
    return F.count("*") if cases is None else F.any_value(cases.agg(F.count("*")).scalar())


def field_accuracy(
    correct: DataFrame, fields: Sequence[str], by: Sequence[str] = ("model",), cases: DataFrame | None = None
) -> DataFrame:
    """Right answers per group and field, the exact rate and the rounded percentage.

    With ``cases``, one row per case, a case without an answer counts as wrong.
    """
    sums = correct.groupBy(*by).agg(
        _n_cases(cases).alias("n_cases"), *[F.sum(f"{f}_correct").alias(f) for f in fields]
    )
    return sums.unpivot([*by, "n_cases"], list(fields), "field", "n_correct").withColumns(_rate("n_correct"))


def overall_accuracy(correct: DataFrame, by: Sequence[str] = ("model",), cases: DataFrame | None = None) -> DataFrame:
    """Exact matches per group, the exact rate and the rounded percentage.

    With ``cases``, one row per case, a case without an answer counts as wrong.
    """
    return correct.groupBy(*by).agg(
        _n_cases(cases).alias("n_cases"), F.sum("correct").alias("n_correct")
    ).withColumns(_rate("n_correct"))


def correctness_matrix(correct: DataFrame, models: Sequence[str], key: str = "case_id") -> DataFrame:
    """One row per case, one 0/1 column per model."""
    return correct.groupBy(key).pivot("model", list(models)).agg(F.max("correct"))


def mismatches(correct: DataFrame, fields: Sequence[str], keep: Sequence[str] = ("case_id", "model")) -> DataFrame:
    """Each wrong field with what was said and what is true; parse errors are left out."""
    compared = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col("parsed")[f].alias("predicted"),
                F.col("ground_truth")[f].alias("actual"),
                F.col("parse_state").alias("state"),
            )
            for f in fields
        ]
    )
    # The state is tested after the explode: before it, the optimizer would move the
    # test below the parsing and parse every answer once more to answer it.
    return (
        correct.select(*keep, F.explode(compared).alias("m"))
        .filter(
            (F.col("m.state") != PARSE_ERROR) & (normalize(F.col("m.predicted")) != normalize(F.col("m.actual")))
        )
        .select(*keep, "m.field", "m.predicted", "m.actual")
    )


def failure_count(listing: DataFrame, key: str = "case_id", by: Sequence[str] = ("model",)) -> DataFrame:
    """Cases with at least one mismatch, per model."""
    return listing.groupBy(*by, key).count().groupBy(*by).agg(F.count("*").alias("failure_cases"))


def failed_samples(scored: DataFrame, model: str, n: int, key: str = "case_id") -> DataFrame:
    """The first ``n`` answers of a model, by id, that could not be parsed."""
    failed = scored.filter((F.col("model") == model) & (F.col("parse_state") == PARSE_ERROR))
    return failed.select(key, "raw").orderBy(key).limit(n)


def run_summary(correct: DataFrame, task: str, key: str = "case_id", stamp: bool = True) -> DataFrame:
    """One row per model with the size of the run, its task and the scores."""
    out = correct.groupBy("model").agg(
        F.count("*").alias("sample_size"),
        F.count_if(F.col("parse_state") == PARSE_ERROR).alias("parse_failures"),
        F.sum("correct").alias("exact_match_count"),
    ).withColumn("task", F.lit(task)).withColumn(
        "exact_match_pct", F.round(F.try_divide(100.0 * F.col("exact_match_count"), F.col("sample_size")), 1)
    )
    return out.withColumn("run_timestamp", F.current_timestamp()) if stamp else out


def accuracy_delta(first: DataFrame, second: DataFrame, on: Sequence[str] = ("model", "field")) -> DataFrame:
    """Accuracy in two tasks side by side and the change from the first to the second."""
    a = first.select(*on, F.col("accuracy").alias("accuracy_first"))
    b = second.select(*on, F.col("accuracy").alias("accuracy_second"))
    return a.join(b, list(on), "full").withColumn("delta", F.col("accuracy_second") - F.col("accuracy_first"))
