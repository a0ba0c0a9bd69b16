"""Numeric operators against plain NumPy on small tables, and their edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalspark import fixtures
from evalspark.operators import anomaly, dbscan, features, kmeans, validity, ward
from evalspark.plans import storage
from evalspark.plans.joins import skew_join
from evalspark.plans.order import exact_quantile, number_rows


def frame(spark, x, **more):
    cols = [f"c{j}" for j in range(x.shape[1])]
    rows = [(i, *map(float, v), *[m[i] for m in more.values()]) for i, v in enumerate(x)]
    schema = ["row_id long", *[f"{c} double" for c in cols], *[f"{n} int" for n in more]]
    return spark.createDataFrame(rows, ", ".join(schema)), cols


def blobs(seed, n, d, copies=0):
    rng = np.random.default_rng(seed)
    centers = rng.uniform(-6, 6, (4, d))
    x = centers[rng.integers(0, 4, n)] + rng.normal(0, 0.6, (n, d))
    x[: n // 20] = rng.uniform(-30, 30, (n // 20, d))
    if copies:
        x = np.vstack([x, np.repeat(x[-3:], copies, axis=0)])
    return x


# --- plans ------------------------------------------------------------------


def test_quantile_by_narrowing(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=3000), np.repeat([1.0, 2.0, 5.0], [2000, 5, 700]), rng.lognormal(0, 4, 2000)):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        for q in (0.0, 0.02, 0.5, 0.98, 1.0):
            assert exact_quantile(df, "x", q, small=50) == pytest.approx(np.quantile(values, q), rel=1e-12)
        assert exact_quantile(df, "x", 0.7, small=50, sketch=8, error=0.0) == pytest.approx(np.quantile(values, 0.7), rel=1e-12)  # the sketch misses
    assert exact_quantile(df.limit(0), "x", 0.5) is None


def test_correlation_in_tiles(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64)) @ rng.normal(size=(64, 64))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 5] = 7.0
    cols = [f"c{i}" for i in range(64)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols)).repartition(5)
    whole, tiled = ({(p["i"], p["j"]): (p["r"], p["n"]) for p in features.correlation_pairs(df, cols, t).collect()} for t in (64, 10))
    assert len(tiled) == 2016 and whole.keys() == tiled.keys()
    want = pd.DataFrame(x).corr().to_numpy()
    for (i, j), (r, n) in tiled.items():
        assert n == whole[i, j][1] and (r is None) == (5 in (i, j))
        assert r is None or (r == pytest.approx(whole[i, j][0], abs=1e-12) and r == pytest.approx(want[i, j], abs=1e-9))
    assert {p["r"] for p in features.correlation_pairs(df.limit(0), cols, 10).collect()} <= {None}


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    got = number_rows(df, [F.col("v")], "n").orderBy("v").collect()
    assert [r["n"] for r in got] == list(range(1000))


def test_skew_join_is_a_join(spark):
    big = spark.range(2000).select("id", F.when(F.col("id") < 900, 1).otherwise(F.col("id") % 50).alias("k"))
    other = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = skew_join(big, other, ["k"], ["id"], how, hot_rows=30)
        want = big.join(other, "k", how).select(got.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    spark.range(4000).toDF("p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    conf = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k"}  # many splits, one of them with rows
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert fixtures.table(spark, str(tmp_path), "part").rdd.getNumPartitions() >= 8
        tasks = fixtures.planted(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks.sum() == 4000 and len(tasks) == 8 and tasks.max() < 1000


def test_distances_in_a_block_are_computed_once_for_all_radii(monkeypatch):
    rng = np.random.default_rng(8)
    x, e2 = rng.uniform(0, 7, (900, 7)).round(1), np.array([2.0, 2.2, 2.4, 2.6, 2.8, 3.0]) ** 2
    level, seen, compute = rng.integers(0, 7, len(x)), [0], dbscan.distances2

    def counted(y, z):
        seen[0] += len(y) * len(z)
        return compute(y, z)

    monkeypatch.setattr(dbscan, "distances2", counted)
    got = dbscan._parts_inside(x, level, e2)
    assert 0 < seen[0] <= 0.75 * len(x) ** 2  # each pair about once; 0.91 where each radius compared its own
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for at, limit in enumerate(e2):
        near = (d2 <= limit + 1e-9) & (level[:, None] <= at) & (level[None] <= at)
        want = np.where(level <= at, np.arange(len(x)), -1)
        while True:
            lower = np.where(want >= 0, np.where(near, want[None], len(x)).min(axis=1), -1)
            if (lower == want).all():
                break
            want = lower
        assert (got[at] == want).all()
    calls = []
    monkeypatch.setattr(dbscan, "_parts_by_points", lambda *a: calls.append(a))
    dbscan._parts_inside(x / 100, level, e2)  # whole leaves lie within the radii
    assert not calls


# --- statistics -------------------------------------------------------------


def test_constant_column_has_no_correlation(spark):
    df, cols = frame(spark, np.column_stack([np.arange(50.0), np.full(50, 0.1), np.arange(50.0) * -2]))
    r = {(p["a"], p["b"]): p["r"] for p in features.correlation_pairs(df, cols).collect()}
    assert r[("c0", "c1")] is None and r[("c1", "c2")] is None and r[("c0", "c2")] == pytest.approx(-1.0)


def test_published_redundancy_counts(spark):
    df, cols = frame(spark, np.random.default_rng(3).normal(size=(80, 68)))
    assert features.redundancy_summary(features.correlation_pairs(df, cols)).first()["total_pairs"] == 2278


def likelihood(x, p):
    up = np.log1p(np.maximum(x, 0)) if abs(p) < 1e-12 else ((np.maximum(x, 0) + 1) ** p - 1) / p
    m = 2 - p
    down = -np.log1p(np.maximum(-x, 0)) if abs(m) < 1e-12 else -((np.maximum(-x, 0) + 1) ** m - 1) / m
    y = np.where(x >= 0, up, down)
    return -0.5 * len(x) * np.log(y.var()) + (p - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def test_power_is_the_most_likely(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.lognormal(0, 1, 400), rng.normal(0, 3, 400), -rng.exponential(2, 400), np.full(400, 3.0),
                         rng.lognormal(0, 0.4, 400) ** -3])
    df, cols = frame(spark, x)
    powers = features.fit_powers(df, cols)
    for j, p in enumerate(powers):
        if j == 3:
            assert p == 1.0
            continue
        a, b = p - 1.0, p + 1.0
        for _ in range(80):
            c, e = b - (b - a) * 0.618034, a + (b - a) * 0.618034
            a, b = (a, e) if likelihood(x[:, j], c) > likelihood(x[:, j], e) else (c, b)
        assert p == pytest.approx((a + b) / 2, abs=2e-4)


def test_scaling_of_constant_column(spark):
    df, cols = frame(spark, np.column_stack([np.arange(4.0), np.full(4, 2.0)]))
    assert {r["c1"] for r in features.standardize(df, cols).collect()} == {0.0}
    assert {r["c1"] for r in features.zscore(df, cols).collect()} == {None}


def test_components_are_orthonormal(spark):
    x = np.random.default_rng(5).normal(size=(300, 5)) @ np.diag([5, 3, 1, 1, 0.5])
    df, cols = frame(spark, x)
    _, loadings, ratio = features.fit_pca(df, cols, 2)
    assert np.allclose(loadings.T @ loadings, np.eye(2), atol=1e-9)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert ratio == pytest.approx(list(values[:2] / values.sum()))
    assert (loadings[np.abs(loadings).argmax(axis=0), [0, 1]] > 0).all()


# --- clustering -------------------------------------------------------------


def test_kmeans_leaves_out_incomplete_rows(spark):
    rows = [(i, float(i % 2) * 10 + i * 0.01, 1.0) for i in range(40)] + [(100, None, 1.0), (101, float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    labels = {r["row_id"]: r["cluster"] for r in kmeans.kmeans(df, ["a", "b"], 2).collect()}
    assert labels == {i: i % 2 for i in range(40)}


def test_passes_of_small_and_large_tables_are_the_same(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(400, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id int, a double, b double, c double")
    for most in (2, 5):  # the starts don't rest so soon
        fits = []
        for local in (10**6, 0):
            monkeypatch.setattr(kmeans, "LOCAL_NUMBERS", local)
            fits.append(kmeans.fit_kmeans(df, ["a", "b", "c"], [6], n_init=2, max_iter=most, tol=1e-9)[6])
        assert fits[0][0] == pytest.approx(fits[1][0], rel=1e-9) and np.allclose(fits[0][1], fits[1][1], atol=1e-9)


def test_quantile_with_infinite_and_nan_values(spark):
    values = [float(i) for i in range(501)] + [float("inf")] * 5 + [float("-inf")] * 3 + [float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    finite = sorted(v for v in values if v is not None and v == v)
    for q in (0.0, 0.001, 0.3, 0.5, 0.98, 1.0):
        at = q * (len(finite) - 1)
        a, b = finite[int(at)], finite[min(int(at) + 1, len(finite) - 1)]
        want = a if at == int(at) or a == b else a + (b - a) * (at - int(at))
        assert exact_quantile(df, "x", q, small=50) == pytest.approx(want)
    flagged = anomaly.flag_top(df, "x", 0.02)
    assert flagged.filter("is_anomaly and isnan(x)").count() == 0 and flagged.filter("is_anomaly").count() > 0


def test_power_with_an_endless_likelihood(spark):
    df = spark.createDataFrame([(10.0 ** (2 * i),) for i in range(84)], "x double")
    assert abs(features.fit_powers(df, ["x"])[0]) < 0.5


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_kmeans(spark, monkeypatch):
    x = blobs(6, 600, 2)
    df, cols = frame(spark, x)
    fits = kmeans.fit_kmeans(df, cols, [2, 4, 6])
    monkeypatch.setattr(kmeans, "LOCAL_NUMBERS", 0)
    spread_out = kmeans.fit_kmeans(df, cols, [2, 4, 6])
    for k in fits:  # the same answer, whatever the plan
        assert fits[k][0] == pytest.approx(spread_out[k][0]) and np.allclose(fits[k][1], spread_out[k][1])
    costs = [fits[k][0] for k in (2, 4, 6)]
    assert costs == sorted(costs, reverse=True)
    cost, centers = fits[4]
    labels = {r["row_id"]: r["cluster"] for r in kmeans.assign(df, cols, centers).collect()}
    d2 = kmeans.distances2(x, centers)
    assert all(d2[i, c] == d2[i].min() for i, c in labels.items())
    assert cost == pytest.approx(d2.min(axis=1).sum())
    rng = np.random.default_rng(0)
    assert cost <= min(kmeans.distances2(x, x[rng.choice(len(x), 4)]).min(axis=1).sum() for _ in range(20))


def test_kmeans_with_fewer_values_than_clusters(spark):
    df, cols = frame(spark, np.repeat([[0.0], [5.0]], 10, axis=0))
    assert kmeans.kmeans(df, cols, 4).select("cluster").distinct().count() == 2


def ward_labels(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = min(
            (len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum(), i, j)
            for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j
        )
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def partition(rows):
    out = {}
    for r in rows:
        out.setdefault(r["cluster"], set()).add(r["row_id"])
    return {frozenset(s) for s in out.values()}


def test_ward_is_exact_on_few_vectors(spark):
    x = np.random.default_rng(7).normal(size=(50, 3))
    df, cols = frame(spark, np.vstack([x, x[:5]]))
    assert partition(ward.ward(df, cols, 6).collect()) == ward_labels(np.vstack([x, x[:5]]), 6)
    heights = ward.merge_order(x, np.ones(50))[:, 2]
    assert len(heights) == 49 and (np.diff(heights) >= 0).all()


@pytest.mark.parametrize("k", [1, 4, 9])
def test_ward_in_rounds_is_exact(spark, k):
    x = np.vstack([np.random.default_rng(9).normal(size=(60, 2)), [[40.0, 40.0], [40.5, 40.0], [-60.0, 0.0]]])
    df, cols = frame(spark, np.vstack([x, x[:5]]))
    assert partition(ward.ward(df, cols, k, block=24, last=16).collect()) == ward_labels(np.vstack([x, x[:5]]), k)


def test_nearest_groups_visit_a_falling_share():
    """The cheapest group is that of every cost, and the share of costs computed falls as groups grow in number."""
    draw, share = np.random.default_rng(4), []
    for n in (1500, 12_000):
        x, w = draw.normal(size=(n, 3)), draw.integers(1, 4, n).astype(float)
        groups, some = ward.Groups(x, w, np.arange(n)), np.arange(0, n, 50)
        cost, place, _ = groups.cheapest(x[some], w[some], some)
        every = ((x[some, None] - x[None]) ** 2).sum(-1) * (w[some, None] * w[None] / (w[some, None] + w[None]))
        every[np.arange(len(some)), some] = np.inf
        assert (place == every.argmin(axis=1)).all() and cost == pytest.approx(every.min(axis=1))
        share.append(groups.seen / every.size)
    assert share[1] < 0.5 * share[0]


def test_ward_on_300_vectors(spark):
    x = np.random.default_rng(12).normal(size=(300, 3))
    df, cols = frame(spark, x)
    order = ward.merge_order(x, np.ones(300))
    group = np.arange(300)
    for a, b, _ in order[: 300 - 7]:
        group[group == group[int(a)]] = group[int(b)]
    want = {frozenset(np.flatnonzero(group == g).tolist()) for g in set(group)}
    assert partition(ward.ward(df, cols, 7, block=120, last=60).collect()) == want


def test_ward_of_ties_and_of_nothing(spark):
    grid = np.array([[i, j] for i in range(6) for j in range(6)], dtype=float)
    df, cols = frame(spark, grid)
    assert len(partition(ward.ward(df, cols, 4, block=16, last=12).collect())) == 4
    assert ward.ward(df.limit(0), cols, 4).count() == 0


def test_ward_on_groups_finds_separate_blobs(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 0.3, (200, 2)) for c in ((0, 0), (10, 0), (0, 10))])
    df, cols = frame(spark, x)
    want = {frozenset(range(a, a + 200)) for a in (0, 200, 400)}
    assert partition(ward.ward(df, cols, 3, block=150, last=40).collect()) == want


def density_labels(x, eps, m):
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    near = d2 <= eps * eps
    core = near.sum(1) >= m
    label, n = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = n
            while todo:
                j = todo.pop()
                for o in np.flatnonzero(near[j] & core & (label < 0)):
                    label[o] = n
                    todo.append(o)
            n += 1
    for i in np.flatnonzero(~core):
        around = label[near[i] & core]
        label[i] = around.min() if len(around) else -1
    return label


@pytest.mark.parametrize("d,copies,block", [(2, 0, 4096), (2, 40, 24), (5, 15, 60)])
def test_density_clusters(spark, d, copies, block):
    x = blobs(9 + d, 500, d, copies)
    df, cols = frame(spark, x)
    eps_list = [0.5, 1.1, 2.5]
    got = dbscan.dbscan_sweep(df, cols, eps_list, 6, block=block).collect()
    for eps in eps_list:
        labels = np.array([r["cluster"] for r in sorted((r for r in got if r["eps"] == eps), key=lambda r: r["row_id"])])
        assert (labels == density_labels(x, eps, 6)).all(), eps


def test_no_density_clusters(spark):
    df, cols = frame(spark, np.arange(20.0)[:, None] * 10)
    labels = dbscan.dbscan_sweep(df, cols, [0.5, 1.0], 3)
    assert labels.filter("cluster <> -1").isEmpty()
    assert dbscan.sweep_summary(labels).filter("chosen").isEmpty()
    row = validity.evaluate_clustering(labels.filter("eps = 1.0").drop("eps"), cols, "none").first()
    assert row["silhouette"] is None and row["n_clusters"] == 0 and row["noise_points"] == 20


def test_silhouette_of_single_row_cluster(spark):
    x = np.array([[0.0], [1.0], [10.0], [11.0], [50.0]])
    df, cols = frame(spark, x, cluster=[0, 0, 1, 1, 2])
    s = [(10.5 - 1) / 10.5, (9.5 - 1) / 9.5, (9.5 - 1) / 9.5, (10.5 - 1) / 10.5, 0.0]
    assert validity.silhouette(df, cols).first()[0] == pytest.approx(np.mean(s))
    assert validity.silhouette(df.filter("cluster = 0"), cols).first()[0] is None


def test_compared_clusterings_are_measured_on_all_rows(spark, monkeypatch):
    from evalspark.queries import profile

    rng = np.random.default_rng(40)
    x = np.vstack([rng.normal(size=(3_000, 7)), rng.normal(size=(2_400, 7)) + 2.0, np.repeat(rng.normal(size=(30, 7)) + 1e4, 20, axis=0)])
    label = np.concatenate([np.repeat([0, 1], [3_000, 2_400]), np.arange(600) % 3 + 2])  # copies in several clusters
    label[:40], label[40] = -1, 9  # noise, and a row alone
    d, kept = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), label >= 0
    names, code = np.unique(label[kept], return_inverse=True)
    n = np.bincount(code)
    sums = np.stack([d[np.ix_(kept, label == c)].sum(1) for c in names], axis=1)
    at = np.arange(len(code))
    inside, mean = sums[at, code] / np.maximum(n[code] - 1, 1), sums / n
    mean[at, code] = np.inf
    outside = mean.min(1)
    s = np.where(n[code] > 1, (outside - inside) / np.maximum(inside, outside), 0.0)
    df, cols = frame(spark, x, cluster=label.tolist())
    monkeypatch.setattr(profile, "SEVEN", cols)
    monkeypatch.setattr(profile, "clusterings", lambda spark, sf: {"given": df})
    assert profile.i15_compare_clusterings(spark, "").first()["silhouette"] == pytest.approx(s.mean(), rel=1e-9)
    # Several passes, whose borders cut clusters.
    few = validity.silhouette_whole(df.filter("cluster <> -1"), cols, block=700)
    assert few.first()[0] == pytest.approx(s.mean(), rel=1e-9)
    assert validity.silhouette_whole(df.filter("cluster = 0"), cols).first()[0] is None
    assert validity.silhouette_whole(df.limit(0), cols).first()[0] is None


def test_many_clusters_in_blocks(spark, monkeypatch):
    x = blobs(13, 300, 2)
    label = np.arange(300) // 6
    df, cols = frame(spark, x, cluster=label.tolist())
    m = np.array([x[label == c].mean(0) for c in range(50)])
    s = np.array([np.linalg.norm(x[label == c] - m[c], axis=1).mean() for c in range(50)])
    gap = np.linalg.norm(m[:, None] - m[None], axis=2)
    np.fill_diagonal(gap, np.inf)
    want = ((s[:, None] + s[None]) / gap).max(axis=1).mean()
    monkeypatch.setattr(validity, "BLOCK", 16)
    assert validity.davies_bouldin(df, cols).first()[0] == pytest.approx(want)


# --- outliers ---------------------------------------------------------------


def lof_values(x, k):
    first = {}
    uid = np.array([first.setdefault(tuple(v), i) for i, v in enumerate(x)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = []
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j] ** 2, uid[j], j))
        near.append(order[:k])
    far = np.array([d[i, near[i][-1]] for i in range(len(x))])
    density = np.array([1 / (np.mean([max(d[i, j], far[j]) for j in near[i]]) + 1e-10) for i in range(len(x))])
    return np.array([np.mean(density[near[i]]) / density[i] for i in range(len(x))])


@pytest.mark.parametrize("d,leaf,copies", [(2, 512, 0), (2, 24, 30), (4, 40, 8)])
def test_local_outlier_factor(spark, d, leaf, copies):
    x = blobs(20 + d, 300, d, copies)
    df, cols = frame(spark, x)
    got = {r["row_id"]: r["lof"] for r in anomaly.lof(df, cols, 10, leaf=leaf).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(list(lof_values(x, 10)), rel=1e-9)


def test_lof_of_few_rows(spark):
    df, cols = frame(spark, np.array([[0.0], [1.0], [2.0]]))
    assert anomaly.lof(df, cols, 20).count() == 3


def test_isolation_scores(spark):
    x = np.vstack([np.random.default_rng(30).normal(size=(800, 3)), [[25.0, -25.0, 25.0]]])
    df, cols = frame(spark, x)
    a = {r["row_id"]: r["score"] for r in anomaly.isolation_forest(df.repartition(1), cols).collect()}
    b = {r["row_id"]: r["score"] for r in anomaly.isolation_forest(df.repartition(5), cols).collect()}
    assert a == b and max(a, key=a.get) == 800 and all(0 < s <= 1 for s in a.values())


def test_published_number_of_flags(spark):
    df = spark.range(25412).select("id", F.xxhash64("id").cast("double").alias("score"))
    assert anomaly.flag_top(df, "score").filter("is_anomaly").count() == 509


def test_published_agreement(spark):
    counts = spark.createDataFrame([(1, 508, 508, 24395)], "both long, only_a long, only_b long, neither long")
    row = anomaly.agreement(counts).first()
    assert (row["flagged_a"], row["flagged_b"]) == (509, 509) and round(row["jaccard"], 3) == 0.001
    assert round(row["pct_a_confirmed"], 1) == 0.2
    none = spark.createDataFrame([(0, 0, 0, 5)], counts.schema)
    assert anomaly.agreement(none).first()["jaccard"] == 0.0


def test_no_small_cluster(spark):
    df, _ = frame(spark, np.zeros((10, 1)), cluster=[0] * 5 + [1] * 5)
    flagged = anomaly.small_clusters(df.withColumn("is_anomaly", F.lit(False)), 0.01)
    row = anomaly.coverage(flagged).first()
    assert row["n_small"] == 0 and row["pct_small_flagged"] is None and row["pct_anomaly_in_small"] is None


def test_passes_rank_centres_by_products_and_settle_what_is_close_by_distances():
    rng = np.random.default_rng(3)
    for shift in (0.0, 1e8):
        x = np.round(rng.normal(size=(3_000, 7)) * 4) / 4 + shift  # a grid, so that many distances are equal
        x = np.vstack([x, x[:500] + rng.normal(size=(500, 7)) * 1e-9])
        for k in (1, 2, 12, 300):
            centers = x[rng.integers(0, len(x), k)]
            d2 = kmeans.distances2(x, centers)
            members = kmeans._members(np.ascontiguousarray(x.T), centers)
            assert (members.sum(axis=0) == 1).all() and (members.argmax(axis=0) == d2.argmin(axis=1)).all()
            near, least = kmeans._nearest(x, centers)
            assert (near == d2.argmin(axis=1)).all() and np.allclose(least, d2.min(axis=1), rtol=1e-12, atol=0)


def test_points_of_the_largest_density_cluster_ask_no_other_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(900, 3)), rng.normal(size=(60, 3)) * 0.2 + 4.0])
    df, cols = frame(spark, x)
    asked, in_shares = [], dbscan.in_shares
    monkeypatch.setattr(dbscan, "in_shares", lambda rows, asking, *a: asked.append(asking.count()) or in_shares(rows, asking, *a))
    got = sorted(dbscan.dbscan(df, cols, 0.8, 6, block=100).collect(), key=lambda r: r["row_id"])
    assert (np.array([r["cluster"] for r in got]) == density_labels(x, 0.8, 6)).all()
    assert asked[0] < len(x) // 4  # 1,000 and more where every point asked every block within the radius


def test_points_ask_only_blocks_with_a_larger_component_in_reach(spark, monkeypatch):
    rng = np.random.default_rng(6)
    far = np.repeat(rng.uniform(-60, 60, (60, 2)), 7, axis=0)  # small components, which stretch the boxes of blocks
    x = np.vstack([rng.uniform(0, 1, (900, 2)), rng.uniform(0, 1, (900, 2)) + [10, 0], far])
    df, cols = frame(spark, x)
    asked, in_shares = [], dbscan.in_shares
    monkeypatch.setattr(dbscan, "in_shares", lambda rows, asking, *a: asked.append(asking.count()) or in_shares(rows, asking, *a))
    got = dbscan.dbscan_sweep(df, cols, [0.4, 3.0], 6, block=60).collect()
    for eps in (0.4, 3.0):
        labels = np.array([r["cluster"] for r in sorted((r for r in got if r["eps"] == eps), key=lambda r: r["row_id"])])
        assert (labels == density_labels(x, eps, 6)).all(), eps
    assert asked[0] < 300, asked  # 3,000 and more where any point asked any block that held another component


def _clouds(rng):
    """Points near zero, far from it, on a grid with ties, and of squares that overflow."""
    yield rng.standard_normal((600, 7))
    yield rng.standard_normal((600, 3)) * 1e-6 + 1e6
    yield np.unique(np.round(rng.standard_normal((900, 2)) * 15), axis=0)
    yield rng.standard_normal((300, 3)) * 1e160


def test_leaves_compute_distances_of_pairs_left_by_a_product_of_matrices(monkeypatch):
    from evalspark.operators import leaves

    rng, exact, compute = np.random.default_rng(16), [0], leaves.pair_distances2

    def counted(y, x):
        exact[0] += len(y)
        return compute(y, x)

    monkeypatch.setattr(leaves, "pair_distances2", counted)
    for x in _clouds(rng):
        d2 = leaves.distances2(x, x)
        d2[np.arange(len(x)), np.arange(len(x))] = np.inf
        limit, exact[0] = np.sort(d2, axis=1)[:, 20], 0
        row, point, dist = leaves.Leaves(x).within(x, np.arange(len(x)), limit)
        wanted = np.argwhere((d2 <= limit[:, None]) & np.isfinite(d2))
        order = np.lexsort((point, row))
        assert np.array_equal(np.column_stack([row, point])[order], wanted) and np.array_equal(dist, d2[row, point])
        assert len(row) <= exact[0] and (abs(x).max() > 1e100 or exact[0] <= 1.1 * (len(row) + len(x)))  # a point itself is among those left


def test_ward_costs_are_computed_of_pairs_left_by_a_product_of_matrices(monkeypatch):
    rng, exact, compute = np.random.default_rng(13), [0], ward.pair_distances2

    def counted(y, x):
        exact[0] += len(y)
        return compute(y, x)

    monkeypatch.setattr(ward, "pair_distances2", counted)
    for x in _clouds(rng):
        w, ids, exact[0] = rng.integers(1, 4, len(x)).astype(float), rng.permutation(len(x)), 0
        groups, own = ward.Groups(x, w, ids), np.arange(len(x))
        cost, place, low = groups.cheapest(x, w, own)
        every = ((x[:, None] - x[None]) ** 2)[..., 0]
        for j in range(1, x.shape[1]):
            every = every + (x[:, None, j] - x[None, :, j]) ** 2
        every *= w[:, None] * w[None] / (w[:, None] + w[None])
        every[own, own] = np.inf
        finite = np.isfinite(every.min(axis=1))
        assert np.array_equal(cost[finite], every.min(axis=1)[finite]) and (low <= cost).all()
        assert all(ids[p] == ids[e == e.min()].min() for p, e in zip(place[finite], every[finite]))
        assert (place[~finite] == -1).all() and (abs(x).max() > 1e100 or exact[0] < groups.seen / 10)
