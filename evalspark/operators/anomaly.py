"""Outlier scores and the agreement of two detectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.blocks import SIZE
from evalspark.operators.boxes import axes, distinct_points, rows_of, spread_to_rows
from evalspark.operators.features import matrix, q
from evalspark.operators.neighbors import nearest_rows
from evalspark.operators.validity import cluster_sizes
from evalspark.plans.joins import lookup_join
from evalspark.plans.order import exact_quantile
from evalspark.plans.storage import cut

CONTAMINATION = 0.02

# --- isolation forest (Liu, Ting & Zhou 2008) -------------------------------

TREES = 100
TREE_ROWS = 256


def path_length(n: float) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _tree_samples(rows: DataFrame, trees: int, size: int, seed: int, n: int, key: str) -> DataFrame:
    """``size`` rows for each tree, drawn by hash: ``(tree, rank, x..)``.

    A first cut by one hash keeps a few times the rows that all trees together
    need, so only those are repeated per tree.
    """
    pool = 8 * trees * size
    unit = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / float(1 << 40))
    candidates = rows.filter(unit < pool / n)  # at every size; below ``pool`` rows all of them
    m = min(n, pool)
    keep = min(1.0, 4.0 * size / m)

    def draw(t):
        return F.xxhash64(F.lit(seed), t, F.col(key))

    wanted = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(draw(t), F.lit(1 << 40)) / float(1 << 40) < keep
    )
    picks = candidates.withColumn("tree", F.explode(wanted)).withColumn("_draw", draw(F.col("tree")))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_draw", key))
    return picks.withColumn("rank", rank).filter(F.col("rank") <= size).drop("_draw", key)


def _grow(d: int, seed: int):
    """Function that grows one tree of random cuts from its few rows."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("rank")[axes(d)].to_numpy()
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(2, len(x))))
        nodes: list[list] = []
        todo = [(np.arange(len(x)), 0, -1, 0)]
        while todo:
            ids, depth, parent, side = todo.pop()
            me = len(nodes)
            lo, hi = x[ids].min(axis=0), x[ids].max(axis=0)
            open_axes = np.flatnonzero(hi > lo)
            if depth >= limit or len(ids) <= 1 or len(open_axes) == 0:
                nodes.append([me, -1, 0.0, me, me, depth + path_length(len(ids))])
            else:
                axis = int(rng.choice(open_axes))
                at = float(rng.uniform(lo[axis], hi[axis]))
                nodes.append([me, axis, at, -1, -1, 0.0])
                right = x[ids, axis] > at
                todo.append((ids[right], depth + 1, me, 1))
                todo.append((ids[~right], depth + 1, me, 0))
            if parent >= 0:
                nodes[parent][3 + side] = me
        out = pd.DataFrame(nodes, columns=["node", "axis", "cut", "left", "right", "depth"])
        out.insert(0, "tree", tree)
        return out

    return grow


def isolation_forest(
    df: DataFrame, columns: Sequence[str], trees: int = TREES, size: int = TREE_ROWS, seed: int = 42,
    key: str = "row_id", out: str = "score",
) -> DataFrame:
    """``(key, out)`` with the isolation score in (0, 1]; higher is more unusual.

    Trees grow in parallel, each from its own few rows. The node table has at most
    ``trees * 2 * size`` rows, by its parameters, and goes to every task.
    """
    d = len(columns)
    rows = rows_of(df, columns, key)
    n = rows.count()
    if n == 0:
        return rows.select(key, F.lit(None).cast("double").alias(out))
    samples = _tree_samples(rows, trees, size, seed, n, key)
    schema = "tree int, node int, axis int, cut double, left int, right int, depth double"
    nodes = samples.groupBy("tree").applyInPandas(_grow(d, seed), schema).toPandas()
    forest = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        forest.append(tuple(t[c].to_numpy() for c in ("axis", "cut", "left", "right", "depth")))
    shared = df.sparkSession.sparkContext.broadcast(forest)
    scale = path_length(min(n, size)) or 1.0
    limit = math.ceil(math.log2(max(2, min(n, size))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b, axes(d))
            at_row = np.arange(len(x))
            depth = np.zeros(len(x))
            for axis, cut_at, left, right, length in shared.value:
                node = np.zeros(len(x), dtype=np.int64)
                for _ in range(limit):
                    a = axis[node]
                    node = np.where(x[at_row, a] > cut_at[node], right[node], left[node])
                depth += length[node]
            s = 2.0 ** (-depth / len(shared.value) / scale)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(s)], names=[key, out])

    return rows.mapInArrow(score, rows.select(key, F.lit(0.0).alias(out)).schema)


def flag_top(df: DataFrame, score: str, contamination: float = CONTAMINATION, out: str = "is_anomaly") -> DataFrame:
    """Flag the scores above the ``1 - contamination`` quantile; null and NaN never are."""
    threshold = exact_quantile(df, score, 1.0 - contamination)
    return df.withColumn(out, F.coalesce((F.col(score) > F.lit(threshold).cast("double")) & ~F.isnan(score), F.lit(False)))


# --- local outlier factor (Breunig et al. 2000) -----------------------------


def lof(df: DataFrame, columns: Sequence[str], k: int = 20, key: str = "row_id", out: str = "lof", leaf: int = SIZE) -> DataFrame:
    """``(key, out)`` with the local outlier factor over the k nearest rows.

    Copies of a vector are neighbours at distance 0 and share one result. With k
    or fewer rows all other rows are neighbours.
    """
    d = len(columns)
    rows = rows_of(df, columns, key)
    points = cut(distinct_points(rows, d, key))
    n = points.agg(F.sum("w")).first()[0] or 0
    k = max(1, min(k, n - 1))
    near = cut(nearest_rows(points, k, d, leaf).withColumn("dist", F.sqrt("d2")))
    copies = F.least(F.col("w") - 1, F.lit(k)).alias("copies")
    far = near.groupBy("uid").agg(F.max("dist").alias("k_dist"))
    reach = cut(
        points.select("uid", copies).join(far, "uid", "left").withColumn("k_dist", F.coalesce("k_dist", F.lit(0.0)))
    )
    others = near.join(reach.select(F.col("uid").alias("other"), F.col("k_dist").alias("other_k")), "other")
    sums = others.groupBy("uid").agg(F.sum(F.col("used") * F.greatest("dist", "other_k")).alias("s"))
    mean = (F.coalesce("s", F.lit(0.0)) + F.col("copies") * F.col("k_dist")) / F.lit(float(k))
    density = cut(
        reach.join(sums, "uid", "left").select("uid", "copies", (1.0 / (mean + 1e-10)).alias("density"))
    )
    around = near.join(density.select(F.col("uid").alias("other"), F.col("density").alias("other_density")), "other")
    totals = around.groupBy("uid").agg(F.sum(F.col("used") * F.col("other_density")).alias("t"))
    factor = (F.coalesce("t", F.lit(0.0)) + F.col("copies") * F.col("density")) / (F.lit(float(k)) * F.col("density"))
    scored = density.join(totals, "uid", "left").select("uid", factor.alias(out))
    results = points.join(scored, "uid").select(*axes(d), out)
    return spread_to_rows(rows, results, points, d, key).select(key, out)


# --- agreement --------------------------------------------------------------


def flag_contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows flagged by both detectors, by one only, and by neither."""
    return df.agg(
        F.count_if(F.col(a) & F.col(b)).alias("both"),
        F.count_if(F.col(a) & ~F.col(b)).alias("only_a"),
        F.count_if(~F.col(a) & F.col(b)).alias("only_b"),
        F.count_if(~F.col(a) & ~F.col(b)).alias("neither"),
    )


def agreement(contingency: DataFrame) -> DataFrame:
    """Flag counts, mutual confirmation in percent and Jaccard similarity; 0 if empty."""
    both, a, b = F.col("both"), F.col("both") + F.col("only_a"), F.col("both") + F.col("only_b")

    def share(part, whole):
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return contingency.select(
        a.alias("flagged_a"), b.alias("flagged_b"), "both", "only_a", "only_b",
        share(100.0 * both, a).alias("pct_a_confirmed"), share(100.0 * both, b).alias("pct_b_confirmed"),
        share(both, a + F.col("only_b")).alias("jaccard"),
    )


def flag_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return agreement(flag_contingency(df, a, b))


def consensus(df: DataFrame, a: str, b: str, n: int = 10, key: str = "row_id") -> DataFrame:
    """The first ``n`` rows, by key, that both detectors flag."""
    return df.filter(F.col(a) & F.col(b)).orderBy(key).limit(n)


def small_clusters(labelled: DataFrame, share: float = 0.01, cluster: str = "cluster", key: str = "row_id", out: str = "in_small_cluster") -> DataFrame:
    """Flag the rows of clusters that hold less than ``share`` of all rows.

    The small clusters are found among the cluster counts; clusters are looked up
    from a broadcast table while there are few, and by a salted join beyond.
    """
    sizes = cut(cluster_sizes(labelled, cluster))
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    small = sizes.select(cluster, (F.col("n") < share * rows).alias(out))
    return lookup_join(labelled, small, [cluster], [key])


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows per combination of two flags: one row per value of ``a``."""
    counts = df.groupBy(a).agg(
        F.count_if(~F.col(b)).alias(f"{b}_false"), F.count_if(F.col(b)).alias(f"{b}_true")
    )
    return counts


def coverage(df: DataFrame, anomaly: str = "is_anomaly", small: str = "in_small_cluster") -> DataFrame:
    """How many small-cluster rows are anomalies and how many anomalies are in small clusters."""
    both = F.count_if(F.col(anomaly) & F.col(small))
    n_small, n_anomaly = F.count_if(F.col(small)), F.count_if(F.col(anomaly))
    return df.agg(
        n_small.alias("n_small"), n_anomaly.alias("n_anomaly"), both.alias("overlap"),
        F.try_divide(100.0 * both, n_small).alias("pct_small_flagged"),
        F.try_divide(100.0 * both, n_anomaly).alias("pct_anomaly_in_small"),
    )


def anomaly_extract(df: DataFrame, keep: Sequence[str], n: int = 10, flag: str = "is_anomaly", key: str = "row_id") -> DataFrame:
    """The first ``n`` flagged rows, by key."""
    return df.filter(F.col(flag)).select(key, *[q(c) for c in keep]).orderBy(key).limit(n)
