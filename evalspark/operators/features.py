"""Statistics and transforms of wide numeric tables.

Columns are plain doubles, so Catalyst prunes them and generates code for them;
per-column facts (means, powers, loadings) are as many as there are columns and
go back into the plan as literals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.plans.storage import cut


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def name(column: str) -> str:
    """Column name for SQL text."""
    return "`" + column.replace("`", "``") + "`"


def matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Rows x columns of an Arrow batch; a null becomes NaN."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)


# --- correlation ------------------------------------------------------------


SUMS = "i int, j int, n double, si double, sj double, qi double, qj double, p double"
TILE = 1_000


def correlation_pairs(df: DataFrame, columns: Sequence[str], tile: int = TILE) -> DataFrame:
    """Pearson correlation ``(a, b, r, n)`` of each pair of columns, a before b.

    A pair uses the rows in which both have a value; a constant column has no
    correlation. Each task reduces its rows to one small matrix of sums, so the
    shuffle carries pairs of columns, never rows. Columns are centred first, which
    keeps the sums of squares from cancelling. Beyond ``tile`` columns a task holds the
    sums of one pair of tiles, ``48 * tile ** 2`` bytes, instead of those of all pairs.
    """
    names = list(columns)
    alias = [f"x{i}" for i in range(len(names))]
    data = df.selectExpr(*[f"nanvl(cast({name(c)} as double), null) as {a}" for c, a in zip(names, alias)])
    means = data.agg(*[F.expr(f"coalesce(avg({a}), 0D) as {a}") for a in alias]).first()
    centre = np.array([means[a] for a in alias])
    i, j = np.triu_indices(len(names), k=1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(centre)
        total = np.zeros((4, d, d))
        for b in batches:
            x = matrix(b, alias) - centre
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x, nan=0.0)
            total += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        n, s, ss, p = total
        yield pa.RecordBatch.from_pydict(
            {
                "i": i.astype("int32"), "j": j.astype("int32"), "n": n[i, j], "si": s[i, j], "sj": s[j, i],
                "qi": ss[i, j], "qj": ss[j, i], "p": p[i, j],
            }
        )

    parts = ("n", "si", "sj", "qi", "qj", "p")
    partial = data.mapInArrow(sums, SUMS) if len(names) <= tile else _tiled_sums(data, alias, centre, tile)
    pairs = partial.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in parts])
    n = F.col("n")

    def spread(s: str, ss: str) -> Column:
        v = n * F.col(ss) - F.col(s) * F.col(s)
        return F.when(v > 1e-12 * n * F.col(ss), v)

    cov = n * F.col("p") - F.col("si") * F.col("sj")
    r = cov / F.sqrt(spread("si", "qi")) / F.sqrt(spread("sj", "qj"))
    # Rounding may leave a hair above 1. Null stays null: greatest() alone would pass over it.
    r = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    label = F.lit(names)
    return pairs.select(
        "i", "j", label[F.col("i")].alias("a"), label[F.col("j")].alias("b"),
        r.alias("r"), n.cast("long").alias("n"),
    )


def _tiled_sums(data: DataFrame, alias: Sequence[str], centre: np.ndarray, tile: int) -> DataFrame:
    """Partial sums of all pairs of columns, from the pairs of tiles of columns.

    Blocks of rows are written once, a tile of columns each. Every tile then meets every
    other one, so as many copies of the data are shuffled as there are tiles.
    """
    d = len(alias)
    starts = range(0, d, tile)
    tall = max(1, (1 << 19) // tile)  # rows of a block of 4 MB

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            for row in range(0, b.num_rows, tall):
                x = matrix(b.slice(row, tall), alias) - centre
                for t, a in enumerate(starts):
                    cells = np.ascontiguousarray(x[:, a : a + tile]).tobytes()
                    yield pa.RecordBatch.from_pydict({"part": [part], "number": [number], "tile": pa.array([t], pa.int32()), "cells": [cells]})
                number += 1

    written = cut(data.mapInArrow(blocks, "part long, number long, tile int, cells binary"))
    tiles = len(starts)
    tasks = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, 2 * tasks // (tiles * (tiles + 1)))
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")
    met = (
        written.select("*", every)
        .select(F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "part", "number", "tile", "cells")
        .repartition("one", "two", F.pmod(F.xxhash64("part", "number"), F.lit(shares)))
        .sortWithinPartitions("one", "two", "part", "number", "tile")
    )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, total, first = None, None, None
        for b in batches:
            for one, two, t, cells in zip(*(b.column(c).to_pylist() for c in ("one", "two", "tile", "cells"))):
                if (one, two) != pair:
                    yield from _pair_rows(pair, total, tile)
                    pair, total = (one, two), 0.0
                x = np.frombuffer(cells).reshape(-1, min(tile, d - t * tile))
                there = ~np.isnan(x)
                x, there = np.where(there, x, 0.0), there.astype(float)
                if t == one:
                    first = (x, there)
                if t == two:
                    y, at = first
                    total = total + np.stack([at.T @ there, y.T @ there, at.T @ x, (y * y).T @ there, at.T @ (x * x), y.T @ x])
        yield from _pair_rows(pair, total, tile)

    return met.mapInArrow(sums, SUMS)


def _pair_rows(pair: tuple[int, int] | None, total: np.ndarray | None, tile: int, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The sums of a pair of tiles, some rows of the first tile at a time."""
    if pair is None:
        return
    for a in range(0, total.shape[1], rows):
        some = total[:, a : a + rows]
        i, j = np.indices(some.shape[1:])
        i, j = i + pair[0] * tile + a, j + pair[1] * tile
        upper = i < j
        yield pa.RecordBatch.from_pydict(
            {"i": i[upper].astype("int32"), "j": j[upper].astype("int32")} | {c: v[upper] for c, v in zip(("n", "si", "sj", "qi", "qj", "p"), some)}
        )


def redundant_pairs(pairs: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Near-duplicate columns: pairs whose absolute correlation is above the threshold."""
    return pairs.filter(F.abs("r") > threshold)


def redundancy_summary(pairs: DataFrame, threshold: float = 0.98) -> DataFrame:
    """All pairs, redundant pairs, their percentage, and the mean absolute correlation."""
    return pairs.agg(
        F.count("*").alias("total_pairs"),
        F.count_if(F.abs("r") > threshold).alias("redundant_pairs"),
        F.try_divide(100.0 * F.count_if(F.abs("r") > threshold), F.count("*")).alias("pct_redundant"),
        F.avg(F.abs("r")).alias("mean_abs_r"),
    )


# --- power transform --------------------------------------------------------

GRID = 8  # grid points on each side of the centre
FIRST_STEP = 0.25
LAST_STEP = 0.005


def yeo_johnson(x: Column, power: Column) -> Column:
    """Yeo-Johnson transform of a column."""
    p = F.lit(2.0) - power
    up = F.when(F.abs(power) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1.0, power) - 1.0) / power)
    down = F.when(F.abs(p) < 1e-12, -F.log1p(-x)).otherwise((1.0 - F.pow(1.0 - x, p)) / p)
    return F.when(x >= 0, up).otherwise(down)


def _transformed(x: np.ndarray, power: float) -> np.ndarray:
    """``yeo_johnson`` of an array."""
    p = 2.0 - power
    up, down = x >= 0, x < 0
    out = np.empty_like(x)
    out[up] = np.log1p(x[up]) if abs(power) < 1e-12 else (np.power(x[up] + 1.0, power) - 1.0) / power
    out[down] = -np.log1p(-x[down]) if abs(p) < 1e-12 else (1.0 - np.power(1.0 - x[down], p)) / p
    return out


def power_likelihood(df: DataFrame, columns: Sequence[str], powers: Sequence[Sequence[float]]) -> DataFrame:
    """Log-likelihood of several powers per column: ``(j, g, power, loglik)``; null for a constant column.

    ``powers[j]`` lists the powers to try for column ``j``; ``g`` counts them. All
    columns and powers share one pass. A task sums up its batches and sends one row per
    column and power.
    """
    wide = df.select(*[q(c).cast("double").alias(f"c{j}") for j, c in enumerate(columns)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], tuple] = {}
        for b in batches:
            for j, tried in enumerate(powers):
                x = b.column(j).drop_null().to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)]
                if not len(x):
                    continue
                logs = float((np.sign(x) * np.log1p(np.abs(x))).sum())
                for g, power in enumerate(tried):
                    with np.errstate(all="ignore"):
                        y = _transformed(x, power)
                        mean = float(y.mean())
                        m2 = float(((y - mean) ** 2).sum())
                    n, l, at, spread, lo, hi = total.get((j, g), (0, 0.0, 0.0, 0.0, math.inf, -math.inf))
                    k, gap = n + len(x), mean - at
                    total[j, g] = (k, l + logs, at + gap * len(x) / k, spread + m2 + gap * gap * n * len(x) / k, min(lo, float(x.min())), max(hi, float(x.max())))
        if total:
            rows = [(j, g, float(powers[j][g]), *t) for (j, g), t in total.items()]
            names = ["j", "g", "power", "n", "logs", "mean", "m2", "lo", "hi"]
            yield pa.RecordBatch.from_pydict({c: list(v) for c, v in zip(names, zip(*rows))}, schema=_SUMS)

    parts = wide.mapInArrow(sums, "j int, g int, power double, n long, logs double, mean double, m2 double, lo double, hi double")
    # One row per task and cell: the common mean is known before the squares are added up.
    cell = Window.partitionBy("j", "g", "power")
    parts = parts.withColumn("all", F.sum(F.col("n") * F.col("mean")).over(cell) / F.sum("n").over(cell))
    n, off = F.sum("n"), F.col("mean") - F.col("all")
    fit = parts.groupBy("j", "g", "power").agg(
        n.alias("n"), F.sum("logs").alias("logs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        (F.sum(F.col("m2") + F.col("n") * off * off) / n).alias("v"),
    )
    loglik = -0.5 * F.col("n") * F.log("v") + (F.col("power") - 1.0) * F.col("logs")
    return fit.select("j", "g", "power", F.when((F.col("v") > 0) & (F.col("lo") < F.col("hi")), loglik).alias("loglik"))


_SUMS = pa.schema([("j", pa.int32()), ("g", pa.int32()), ("power", pa.float64()), ("n", pa.int64()), *[(c, pa.float64()) for c in ("logs", "mean", "m2", "lo", "hi")]])


def fit_powers(df: DataFrame, columns: Sequence[str]) -> list[float]:
    """Most likely Yeo-Johnson power of each column; 1 for a constant column.

    Each job tries a grid of powers for all columns. A best power inside the grid
    narrows it eightfold, one at the edge moves it. A parabola through the best
    three points of the last grid gives the result. Points whose likelihood is not a
    finite number are left out; a column that never comes to rest is an error.
    """
    centre = [0.0] * len(columns)
    step = [FIRST_STEP] * len(columns)
    result = [1.0] * len(columns)
    open_columns = set(range(len(columns)))
    for turn in range(60):
        if not open_columns:
            return result
        grid = [[centre[j] + (g - GRID) * step[j] for g in range(2 * GRID + 1)] for j in range(len(columns))]
        tried = power_likelihood(df, columns, grid).collect()  # one row per column and grid point
        values = {(r["j"], r["g"]): r["loglik"] for r in tried}
        for j in list(open_columns):
            l = [values.get((j, g)) for g in range(2 * GRID + 1)]
            if turn == 0 and l[round(GRID + 1 / FIRST_STEP)] is None:  # the power 1 changes nothing: a constant or empty column
                open_columns.discard(j)
                continue
            l = [-math.inf if v is None or not math.isfinite(v) else v for v in l]
            if max(l) == -math.inf:
                open_columns.discard(j)
                continue
            best = max(range(len(l)), key=lambda g: l[g])
            centre[j] = result[j] = grid[j][best]
            if 0 < best < len(l) - 1:
                if step[j] <= LAST_STEP:
                    bend = l[best - 1] - 2 * l[best] + l[best + 1]
                    if -math.inf < bend < 0:
                        result[j] += step[j] * 0.5 * (l[best - 1] - l[best + 1]) / bend
                    open_columns.discard(j)
                step[j] /= GRID
    if open_columns:
        raise RuntimeError(f"no likeliest power found for {[columns[j] for j in sorted(open_columns)]}")
    return result


def apply_powers(df: DataFrame, columns: Sequence[str], powers: Sequence[float]) -> DataFrame:
    return df.withColumns({c: yeo_johnson(q(c).cast("double"), F.lit(float(p))) for c, p in zip(columns, powers)})


def power_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Yeo-Johnson transform of each column with its most likely power."""
    return apply_powers(df, columns, fit_powers(df, columns))


# --- scaling ----------------------------------------------------------------


def _moments(df: DataFrame, columns: Sequence[str], ddof: int) -> list[tuple[float, float]]:
    sd = "stddev_samp" if ddof else "stddev_pop"
    facts = [f"{f}({name(c)}) as {n}{i}" for i, c in enumerate(columns) for n, f in (("m", "avg"), ("s", sd))]
    row = df.agg(*[F.expr(f) for f in facts]).first()
    return [(row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i in range(len(columns))]


def standardize(df: DataFrame, columns: Sequence[str], ddof: int = 0) -> DataFrame:
    """Mean 0 and standard deviation 1 per column; a constant column becomes 0."""
    moments = zip(columns, _moments(df, columns, ddof))
    return df.withColumns({c: F.expr(f"({name(c)} - {m!r}D) / {s if s > 0 else 1.0!r}D") for c, (m, s) in moments})


def zscore(df: DataFrame, columns: Sequence[str], ddof: int = 1) -> DataFrame:
    """Distance from the mean in sample standard deviations; null for a constant column."""
    moments = zip(columns, _moments(df, columns, ddof))
    return df.withColumns(
        {c: F.expr(f"({name(c)} - {m!r}D) / {s!r}D" if s > 0 else "cast(null as double)") for c, (m, s) in moments}
    )


# --- principal components ---------------------------------------------------


def fit_pca(df: DataFrame, columns: Sequence[str], k: int = 2) -> tuple[list[float], np.ndarray, list[float]]:
    """Column means, loadings (columns x k) and explained-variance ratios.

    The largest loading of each component is positive, so the sign is settled.
    """
    means = [m for m, _ in _moments(df, columns, 0)]
    centred = df.selectExpr(*[f"{name(c)} - {m!r}D as c{i}" for i, (c, m) in enumerate(zip(columns, means))])
    vectors = VectorAssembler(inputCols=[f"c{i}" for i in range(len(columns))], outputCol="v").transform(centred)
    model = PCA(k=k, inputCol="v", outputCol="p").fit(vectors.select("v"))
    loadings = model.pc.toArray()
    strongest = np.abs(loadings).argmax(axis=0)
    loadings = loadings * np.where(loadings[strongest, range(k)] < 0, -1.0, 1.0)
    return means, loadings, [float(v) for v in model.explainedVariance]


def pca(df: DataFrame, columns: Sequence[str], k: int = 2, prefix: str = "pca_") -> DataFrame:
    """Scores on the first ``k`` principal components, as ``pca_1`` to ``pca_k``."""
    means, loadings, _ = fit_pca(df, columns, k)
    scores = {}
    for j in range(k):
        terms = [f"({name(c)} - {m!r}D) * {float(loadings[i, j])!r}D" for i, (c, m) in enumerate(zip(columns, means))]
        scores[f"{prefix}{j + 1}"] = F.expr(" + ".join(terms))
    return df.withColumns(scores)


def pca_variance(df: DataFrame, columns: Sequence[str], k: int = 2) -> DataFrame:
    """Explained-variance ratio per component."""
    _, _, ratio = fit_pca(df, columns, k)
    return df.sparkSession.createDataFrame(
        [(j + 1, r) for j, r in enumerate(ratio)], "component int, explained_ratio double"
    )
