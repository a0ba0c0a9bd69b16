"""Pattern screening of free texts against a rubric."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import any_pattern, word_count

# The rubric's checks and their patterns.
STRUCTURAL = {
    "goal_purpose": [r"\bgoal\b", r"\bpurpose\b", r"\baim(s)?\b"],
    "intended_application": ["intended application", "intended use", "application"],
    "target_audience": ["target audience", "audience", "stakeholder"],
    "functional_unit": ["functional unit"],
    "system_boundaries": ["system boundar", "cradle-to-", "gate-to-gate"],
    "assumptions_limitations": ["assumption", "limitation"],
}
PRECISION = {
    "comparative_assertions": ["comparative assertion"],
    "allocation_methodology": ["allocation"],
    "capital_goods": ["capital (equipment|goods)", "infrastructure"],
    "iso_citation": ["iso 14040", "iso 14044"],
}


def present(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")) != ""


def rubric_flags(df: DataFrame, text: str, checks: Mapping[str, Sequence[str]]) -> DataFrame:
    """One 0/1 column per check: does any of its patterns occur? A missing text has none."""
    return df.withColumns(
        {name: F.coalesce(present(text) & any_pattern(F.col(text), p), F.lit(False)).cast("int") for name, p in checks.items()}
    )


def rubric_counts(flags: DataFrame, checks: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """Texts per group that pass each check, one column per check."""
    return flags.groupBy(*by).agg(*[F.sum(c).alias(c) for c in checks])


def rubric_counts_long(counts: DataFrame, checks: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    return counts.unpivot(list(by), list(checks), "check", "n_present")


def completeness(counts: DataFrame, checks: Sequence[str], n_cases: Column, by: Sequence[str] = ("model",)) -> DataFrame:
    """Passed checks as a percentage of all checks in all cases, missing texts included."""
    passed = sum((F.col(c) for c in checks), F.lit(0))
    possible = F.lit(len(checks)) * n_cases
    return counts.select(
        *by, passed.cast("long").alias("n_present"), possible.cast("long").alias("n_possible")
    ).withColumn("completeness_pct", F.try_divide(100.0 * F.col("n_present"), F.col("n_possible")))


def avg_words(df: DataFrame, text: str = "draft", by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean number of words of the texts that are there; 0 if none is."""
    return df.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(present(text), word_count(F.col(text)))), F.lit(0.0)).alias("avg_words")
    )


def missing_drafts(df: DataFrame, text: str = "draft", by: Sequence[str] = ("model",), cases: DataFrame | None = None) -> DataFrame:
    """Texts that are not there; with ``cases``, one row per case, also those without a row."""
    if cases is None:
        return df.groupBy(*by).agg(F.count_if(~present(text)).alias("missing_drafts"))
    n = F.any_value(cases.agg(F.count("*")).scalar())
    return df.groupBy(*by).agg((n - F.count_if(present(text))).alias("missing_drafts"))


def review_extract(df: DataFrame, cases: Sequence, models: Sequence[str], key: str = "case_id", text: str = "draft") -> DataFrame:
    """Chosen cases side by side for chosen models; ``MISSING`` where no text is stored."""
    chosen = df.filter(F.col(key).isin(list(cases)) & F.col("model").isin(list(models)))
    wide = chosen.groupBy(key).pivot("model", list(models)).agg(F.min(text))
    return wide.na.fill("MISSING", subset=list(models))
