"""Order statistics and numbering without sorting everything in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.plans.storage import cut

# Largest number of distinct values one task or the driver may hold.
SMALL = 100_000
BINS = 2_000
# Size of the sketch behind a quantile, and how far its ranks are trusted: beyond 99 % confidence at this size.
SKETCH = 4_096
ERROR = 0.002


def exact_quantile(df: DataFrame, column: str, q: float, small: int = SMALL, sketch: int = SKETCH, error: float = ERROR) -> float | None:
    """Linearly interpolated quantile, as ``percentile`` gives it, at any size.

    ``percentile`` keeps every distinct value in one buffer. Here one pass builds a KLL
    sketch, whose quantiles bracket the wanted ranks, and a second one counts the rows
    below the bracket and each value inside it, so the answer is exact. Where the sketch
    misses (odds of 1 in 100 at most), all values are counted. The column is written out
    first, as it is read twice. NaN counts as null; infinite values are counted, not
    searched. Null for an empty column.
    """
    x = cut(df.select(F.col(column).cast("double").alias("x")).dropna())
    endless = F.col("x").isin(math.inf, -math.inf)
    finite = F.when(~endless, F.col("x"))
    n, below, above, low, high, seen = x.agg(
        F.count("x"), F.count_if(F.col("x") == -math.inf), F.count_if(F.col("x") == math.inf), F.min(finite), F.max(finite),
        F.kll_sketch_agg_double(finite, sketch),
    ).first()
    if n == 0:
        return None
    x = x.filter(~endless)
    rank = (n - 1) * q
    first, second = math.floor(rank), math.ceil(rank)
    inner = [r - below for r in (first, second) if below <= r < n - above]
    found = _values_at(x, inner, n - below - above, low, high, bytes(seen), error, small) if inner else {}

    def at(r: int) -> float:
        return -math.inf if r < below else math.inf if r >= n - above else found[r - below]

    a, b = at(first), at(second)
    return a if a == b else a + (b - a) * (rank - first)


def _values_at(x: DataFrame, ranks: list[int], n: int, low: float, high: float, seen: bytes, error: float, small: int) -> dict[int, float]:
    """Values at the 0-based neighbouring ``ranks`` of the ``n`` rows, all within [low, high]."""
    ends = [max(0.0, ranks[0] / n - error), min(1.0, (ranks[-1] + 1) / n + error)]
    quantiles = F.kll_sketch_get_quantile_double(F.lit(bytearray(seen)), F.array(*[F.lit(e) for e in ends]))
    left, right = x.sparkSession.range(1).select(quantiles).first()[0]
    left, right = (low if ends[0] == 0 else left), (high if ends[1] == 1 else right)
    value = F.when(F.col("x") >= left, F.col("x"))  # null below the bracket
    counted = cut(x.filter(F.col("x") <= right).groupBy(value.alias("x")).agg(F.count("*").alias("n")))
    under, inside = counted.agg(F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("n"))), F.lit(0))).first()
    if not under <= ranks[0] <= ranks[-1] < under + inside:
        under, left, right = 0, low, high
        counted = cut(x.groupBy("x").agg(F.count("*").alias("n")))
    values = counted.dropna()
    return {r: _order_statistic(values, r - under, left, right, small) for r in ranks}


def _order_statistic(values: DataFrame, rank: int, low: float, high: float, small: int) -> float:
    """Value at 0-based ``rank`` where each ``x`` in [low, high] stands for ``n`` rows."""
    below = 0  # rows known to be smaller than low
    distinct = values.count()
    while distinct > small and low < high:
        width = high / BINS - low / BINS
        if low + width <= low:
            break
        last = (low, high)
        bins = (
            values.filter(F.col("x").between(low, high))
            .groupBy(F.least(F.floor((F.col("x") - low) / width), F.lit(BINS - 1)).alias("bin"))
            .agg(F.sum("n").alias("n"), F.count("*").alias("distinct"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .orderBy("bin")
            .collect()  # at most BINS rows
        )
        for b in bins:
            if below + b["n"] > rank:
                low, high, distinct = b["lo"], b["hi"], b["distinct"]
                break
            below += b["n"]
        if (low, high) == last:
            break
    if low == high:
        return low
    for v in values.filter(F.col("x").between(low, high)).orderBy("x").toLocalIterator():
        below += v["n"]
        if below > rank:
            return v["x"]
    raise ValueError("the rows changed while the quantile was computed")


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add consecutive numbers 0..n-1 in the given order, without a global window.

    The rows are range-partitioned and written out; each partition's offset is the
    count of the ones before it.
    """
    ranged = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_mono").alias("start"))
    offset, total = {}, 0
    for row in counts.orderBy("_part").collect():  # one row per partition
        offset[row["_part"]] = total - row["start"]
        total += row["n"]
    if not offset:
        return df.withColumn(name, F.lit(None).cast("long"))
    shift = F.create_map(*[F.lit(v) for kv in offset.items() for v in (kv[0], kv[1])])
    return ranged.withColumn(name, F.col("_mono") + shift[F.col("_part")]).drop("_part", "_mono")
