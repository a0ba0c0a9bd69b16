"""Paired significance tests between raters, for many test families in one job.

All start from a long table ``(family.., case_id, model, correct)``. With few raters the
cases are counted by their pattern of right and wrong. With many raters hardly two cases
agree, and slices of bits take the place of patterns: one bit per case and rater.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.stats import chi2_sf, mcnemar_p
from evalspark.plans.order import number_rows
from evalspark.plans.storage import cut, spread

SLICE = 32_768  # cases in a slice of bits: what ``bitmap_construct_agg`` holds


def answer_patterns(correct: DataFrame, by: Sequence[str] = (), key: str = "case_id") -> DataFrame:
    """How many cases show each pattern of right and wrong over the raters.

    ``pattern`` is a list of (model, correct), sorted by model. With k raters there
    are at most 2**k patterns, so the tests below never see the cases again. The
    counts are written out at once, as every test starts from them. A rater without a
    row for a case of its family is wrong there.
    """
    # Dealt by case into a fixed number of tasks first: counts per case and rater are far larger than the
    # bytes shuffled, by which adaptive execution would merge them into a few tasks.
    dealt = spread(correct.select(*by, key, "model", "correct"), *by, key)
    one = dealt.groupBy(*by, key, "model").agg(F.max("correct").cast("int").alias("correct"))
    per_case = one.groupBy(*by, key).agg(F.array_sort(F.collect_list(F.struct("model", "correct"))).alias("pattern"))
    return cut(_completed(cut(per_case.groupBy(*by, "pattern").agg(F.count("*").alias("n_cases"))), by))


def _completed(patterns: DataFrame, by: Sequence[str]) -> DataFrame:
    """Give every pattern all raters of its family, in order, and add up what became equal."""
    raters = _grouped(patterns.select(*by, F.explode("pattern.model").alias("m")), by).agg(F.array_sort(F.collect_set("m")).alias("raters"))
    named = patterns.join(raters, list(by)) if by else patterns.withColumn("raters", raters.scalar())
    said = F.map_from_entries("pattern")
    full = F.transform("raters", lambda m: F.struct(m.alias("model"), F.coalesce(said[m], F.lit(0)).alias("correct")))
    return named.select(*by, full.alias("pattern"), "n_cases").groupBy(*by, "pattern").agg(F.sum("n_cases").alias("n_cases"))


def discordant(correct: DataFrame, a: str, b: str, by: Sequence[str] = (), key: str = "case_id") -> DataFrame:
    """Cases where only rater b is right, and where only rater a is right.

    A rater without a row for a case is wrong there.
    """
    pair = correct.filter(F.col("model").isin(a, b)).groupBy(*by, key).agg(
        F.coalesce(F.max(F.when(F.col("model") == a, F.col("correct").cast("int"))), F.lit(0)).alias("_a"),
        F.coalesce(F.max(F.when(F.col("model") == b, F.col("correct").cast("int"))), F.lit(0)).alias("_b"),
    )
    counted = pair.groupBy(*by) if by else pair.groupBy()
    return counted.agg(
        F.count_if((F.col("_a") == 0) & (F.col("_b") == 1)).alias("a_wrong_b_right"),
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).alias("a_right_b_wrong"),
    ).select(*by, F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), "a_wrong_b_right", "a_right_b_wrong")


def pairwise_discordant(patterns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Discordant counts of every pair of raters, from the pattern counts."""
    pairs = F.flatten(
        F.transform(
            "pattern",
            lambda a: F.transform(
                F.filter("pattern", lambda b: b["model"] > a["model"]),
                lambda b: F.struct(
                    a["model"].alias("model_a"), b["model"].alias("model_b"),
                    a["correct"].alias("a"), b["correct"].alias("b"),
                ),
            ),
        )
    )
    n = F.col("n_cases")
    return (
        patterns.select(*by, "n_cases", F.explode(pairs).alias("p"))
        .groupBy(*by, F.col("p.model_a").alias("model_a"), F.col("p.model_b").alias("model_b"))
        .agg(
            F.sum(F.when((F.col("p.a") == 0) & (F.col("p.b") == 1), n).otherwise(0)).alias("a_wrong_b_right"),
            F.sum(F.when((F.col("p.a") == 1) & (F.col("p.b") == 0), n).otherwise(0)).alias("a_right_b_wrong"),
        )
    )


def bit_slices(correct: DataFrame, by: Sequence[str] = (), key: str = "case_id") -> DataFrame:
    """``(by.., model, slice, bits)``: a bit for each case that a rater has right.

    Cases are numbered through, so the slices are full. A rater without a row for a case,
    or with a wrong one, has no bit there; one that is never right has no slice.
    """
    cases = number_rows(correct.select(*by, key).distinct(), [F.col(c) for c in (*by, key)], "_n")
    right = correct.filter(F.col("correct").cast("int") == 1).join(cases, [*by, key]).withColumn("_n", F.col("_n") + 1)
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("bits")
    return right.groupBy(*by, "model", F.bitmap_bucket_number("_n").alias("slice")).agg(bits)


def rights_of_pairs(correct: DataFrame, by: Sequence[str] = (), key: str = "case_id", cases_per_group: int = 16 * SLICE) -> DataFrame:
    """``(by.., model_a, model_b, right_a, right_b, right_both)`` of every pair of raters.

    A task takes the slices of some cases, all raters of them, and ANDs them pair by pair.
    """
    slices = bit_slices(correct, by, key)
    group = F.floor(F.col("slice") * SLICE / cases_per_group)
    dealt = slices.select(*by, group.cast("long").alias("_group"), "model", "slice", "bits")
    names, types = list(by), [correct.schema[c].dataType.simpleString() for c in by]
    fields = "".join(f"`{c}` {t}, " for c, t in zip(names, types))

    def both(t: pa.Table) -> pa.Table:
        raters = sorted(set(t.column("model").to_pylist()))
        place, first = {m: i for i, m in enumerate(raters)}, t.slice(0, 1)
        count = np.zeros((len(raters), len(raters)), dtype=np.int64)
        for part in sorted(set(t.column("slice").to_pylist())):
            held = t.filter(pa.compute.equal(t.column("slice"), part))
            bits = np.stack([np.frombuffer(b, dtype="<u8") for b in held.column("bits").to_pylist()])
            at = np.array([place[m] for m in held.column("model").to_pylist()])
            for i, own in zip(at, bits):
                count[i, at] += np.bitwise_count(bits & own).sum(axis=1, dtype=np.int64)
        i, j = np.triu_indices(len(raters))
        some = count[i, j] > 0
        i, j = i[some], j[some]
        family = [pa.array(first.column(c).to_pylist() * len(i), t.schema.field(c).type) for c in names]
        return pa.Table.from_arrays([*family, pa.array([raters[x] for x in i], pa.string()), pa.array([raters[x] for x in j], pa.string()), pa.array(count[i, j])], [*names, "model_a", "model_b", "n"])

    keys = [*names, "_group"]
    met = spread(dealt, *keys).groupBy(*keys).applyInArrow(both, f"{fields}model_a string, model_b string, n long")
    counts = cut(met.groupBy(*names, "model_a", "model_b").agg(F.sum("n").alias("n")))
    raters = _grouped(correct, by).agg(F.array_sort(F.collect_set("model")).alias("raters"))
    later = F.transform("raters", lambda a: F.struct(a.alias("model_a"), F.filter("raters", lambda b: b > a).alias("others")))
    pairs = raters.select(*names, F.explode(later).alias("p")).select(*names, "p.model_a", F.explode("p.others").alias("model_b"))
    one = counts.filter(F.col("model_a") == F.col("model_b"))
    for side in ("a", "b"):
        pairs = pairs.join(one.select(*names, F.col("model_a").alias(f"model_{side}"), F.col("n").alias(f"right_{side}")), [*names, f"model_{side}"], "left")
    pairs = pairs.join(counts.withColumnRenamed("n", "right_both"), [*names, "model_a", "model_b"], "left")
    return pairs.select(*names, "model_a", "model_b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("right_a", "right_b", "right_both")])


def pairwise_discordant_bits(correct: DataFrame, by: Sequence[str] = (), key: str = "case_id", cases_per_group: int = 16 * SLICE) -> DataFrame:
    """``pairwise_discordant`` by slices of bits, for any number of raters."""
    pairs = rights_of_pairs(correct, by, key, cases_per_group)
    return pairs.select(
        *by, "model_a", "model_b", (F.col("right_b") - F.col("right_both")).alias("a_wrong_b_right"),
        (F.col("right_a") - F.col("right_both")).alias("a_right_b_wrong"),
    )


def mcnemar_exact(pairs: DataFrame, b: str = "a_wrong_b_right", c: str = "a_right_b_wrong") -> DataFrame:
    """Exact two-sided McNemar probability per pair; 1 without a discordant case."""
    return pairs.withColumn("p_value", mcnemar_p(F.col(b), F.col(c)))


def cochrans_q(patterns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cochran's Q per family with its upper-tail probability; null if undefined.

    ``patterns`` holds every rater of a family in each pattern, as ``answer_patterns`` sees to.
    """
    n = F.col("n_cases")
    rater = (
        patterns.select(*by, "n_cases", F.explode("pattern").alias("r"))
        .groupBy(*by, F.col("r.model").alias("model"))
        .agg(F.sum(n * F.col("r.correct")).cast("double").alias("c"))
    )
    rater_sums = _grouped(rater, by).agg(
        F.count("*").alias("k"), F.sum("c").alias("total"), F.sum(F.col("c") * F.col("c")).alias("c2")
    )
    row = F.aggregate("pattern", F.lit(0), lambda s, r: s + r["correct"]).cast("double")
    case_sums = _grouped(patterns.withColumn("row", row), by).agg(F.sum(n * F.col("row") * F.col("row")).alias("r2"))
    joined = rater_sums.join(case_sums, list(by)) if by else rater_sums.withColumn("r2", case_sums.scalar())
    return _q(joined, by)


def cochrans_q_bits(correct: DataFrame, by: Sequence[str] = (), key: str = "case_id") -> DataFrame:
    """``cochrans_q`` by slices of bits: squares of the cases' sums are the rights of pairs, added up.

    For families of two raters or more; one rater alone has no pair and gives no row.
    """
    pairs = cut(rights_of_pairs(correct, by, key))
    one = pairs.select(*by, F.col("model_a").alias("model"), F.col("right_a").alias("c")).unionByName(
        pairs.select(*by, F.col("model_b").alias("model"), F.col("right_b").alias("c"))
    ).distinct()
    c = F.col("c").cast("double")
    rater_sums = _grouped(one, by).agg(F.count("*").alias("k"), F.sum(c).alias("total"), F.sum(c * c).alias("c2"))
    both = _grouped(pairs, by).agg(F.sum(F.col("right_both").cast("double")).alias("both"))
    joined = rater_sums.join(both, list(by)) if by else rater_sums.withColumn("both", both.scalar())
    return _q(joined.withColumn("r2", F.col("total") + 2 * F.col("both")), by)


def _q(joined: DataFrame, by: Sequence[str]) -> DataFrame:
    """From ``k`` raters, the sums ``total`` and ``c2`` of their rights and of the squares, and ``r2`` of the cases' squares."""
    spread = F.col("c2") - F.col("total") * F.col("total") / F.col("k")
    q = F.try_divide(F.col("k") * (F.col("k") - 1) * spread, F.col("k") * F.col("total") - F.col("r2"))
    return joined.select(
        *by, F.col("k").alias("n_raters"), q.alias("q"), (F.col("k") - 1).cast("int").alias("df")
    ).withColumn("p_value", chi2_sf("q", "df"))


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


def bonferroni(tests: DataFrame, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Corrected level per family of tests and whether each test reaches it.

    Tests are one row per pair of raters.
    """
    family = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return tests.withColumn("bonferroni_alpha", F.lit(alpha) / F.count("*").over(family)).withColumn(
        "significant", F.col("p_value") < F.col("bonferroni_alpha")
    )


def verdict(tests: DataFrame, p: str = "p_value", alpha: float = 0.05, out: str = "verdict") -> DataFrame:
    """Say in words what a probability means at a level; null has no verdict."""
    return tests.withColumn(
        out,
        F.when(F.col(p).isNull(), "no test possible")
        .when(F.col(p) < alpha, "statistically significant")
        .otherwise("not statistically significant"),
    )
