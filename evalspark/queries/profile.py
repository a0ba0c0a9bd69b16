"""Statistics, transforms, clusterings and outliers of numeric tables (sections H to J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import fixtures as X
from evalspark.operators import anomaly, dbscan, features, kmeans, validity, ward
from evalspark.operators.cleaning import complete_cases
from evalspark.plans.storage import cut, new_folder, use_all_cores
from evalspark.queries.ctes import sql
from evalspark.queries.records import d6, r6
from evalspark.sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


SEVEN, WIDE, TWO = X.FEATURES7, X.FEATURES64, X.PLANTED


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Seven features, power-transformed and scaled: the input of every fit. Written once."""
    complete = use_all_cores(cut(complete_cases(X.features7(spark, sf), SEVEN)))
    return cut(features.standardize(features.power_transform(complete, SEVEN), SEVEN))


# --- H ----------------------------------------------------------------------

PAIRS64 = """pairs as (
  select a.j as i, b.j as j, 'f' || lpad(cast(a.j as varchar), 2, '0') as a, 'f' || lpad(cast(b.j as varchar), 2, '0') as b,
    corr(a.x, b.x) as r, count(*) as n
  from long64 a join long64 b on a.row_id = b.row_id and a.j < b.j group by a.j, b.j)"""


@query(sql(["long64"], f"select a, b, {d6('r')} as r, n from pairs", PAIRS64))
def h01_correlation_pairs(spark, sf):
    pairs = features.correlation_pairs(X.wide_features(spark, sf), WIDE)
    return pairs.select("a", "b", r6("r").alias("r"), "n")


@query(sql(["clean"], f"""
select a.name as a, b.name as b, {d6('corr(a.x, b.x)')} as r, count(*) as n
from tall a join tall b on a.row_id = b.row_id and a.name < b.name group by a.name, b.name""",
    f"tall as (unpivot clean on {', '.join(SEVEN)} into name name value x)"))
def h01_correlation_pairs_missing(spark, sf):
    from evalspark.operators.cleaning import coerce_numeric

    pairs = features.correlation_pairs(coerce_numeric(X.dirty(spark, sf), SEVEN), SEVEN)
    return pairs.select("a", "b", r6("r").alias("r"), "n")


@query(sql(["long64"], f"select a, b, {d6('r')} as r from pairs where abs(r) > 0.1", PAIRS64))
def h02_redundant_pairs(spark, sf):
    pairs = features.correlation_pairs(X.wide_features(spark, sf), WIDE)
    return features.redundant_pairs(pairs, 0.1).select("a", "b", r6("r").alias("r"))


@query(sql(["long64"], f"""
select count(*) as total_pairs, count(*) filter (where abs(r) > 0.1) as redundant_pairs,
  {d6('100.0 * count(*) filter (where abs(r) > 0.1) / count(*)')} as pct_redundant, {d6('avg(abs(r))')} as mean_abs_r
from pairs""", PAIRS64))
def h03_redundancy_summary(spark, sf):
    pairs = features.correlation_pairs(X.wide_features(spark, sf), WIDE)
    out = features.redundancy_summary(pairs, 0.1)
    return out.withColumns({c: r6(c) for c in ("pct_redundant", "mean_abs_r")})


POWERS = [-1.0, 0.0, 0.5, 1.0, 2.0]
LIKELIHOOD = " union all ".join(
    f"""select '{c}' as name, l as power, round(-0.5 * count(*) * ln(var_pop(
      case when {c} >= 0 then case when l = 0 then ln({c} + 1) else (pow({c} + 1, l) - 1) / l end
           else case when l = 2 then -ln(1 - {c}) else -(pow(1 - {c}, 2 - l) - 1) / (2 - l) end end))
      + (l - 1) * sum(sign({c}) * ln(abs({c}) + 1)), 4) + 0.0 as loglik
    from shifted cross join (values {', '.join(f'(cast({p} as double))' for p in POWERS)}) t(l) group by l"""
    for c in SEVEN
)


@query(sql(["features7"], LIKELIHOOD, "shifted as (select row_id, "
           + ", ".join(f"{c} - 20 as {c}" if c in ("f00", "f06") else c for c in SEVEN) + " from features7)"))
def h04_power_likelihood(spark, sf):
    shifted = X.features7(spark, sf).withColumns({c: F.col(c) - 20 for c in ("f00", "f06")})
    table = features.power_likelihood(shifted, SEVEN, [POWERS] * len(SEVEN))
    name = F.array(*[F.lit(c) for c in SEVEN])[F.col("j")].alias("name")
    return table.select(name, "power", (F.round("loglik", 4) + F.lit(0.0)).alias("loglik"))


@query(sql(["features7"], f"""
select name, min(power) as power from (select *, max(loglik) over (partition by name) as most from ({LIKELIHOOD})) where loglik = most group by name""", "shifted as (select row_id, "
           + ", ".join(f"{c} - 20 as {c}" if c in ("f00", "f06") else c for c in SEVEN) + " from features7)"))
def h04_best_power(spark, sf):
    shifted = X.features7(spark, sf).withColumns({c: F.col(c) - 20 for c in ("f00", "f06")})
    table = features.power_likelihood(shifted, SEVEN, [POWERS] * len(SEVEN))
    name = F.array(*[F.lit(c) for c in SEVEN])[F.col("j")].alias("name")
    best = F.max(F.struct(F.round("loglik", 4), -F.col("power"))).alias("best")  # of equals the smaller power
    return table.select(name, "power", "loglik").groupBy("name").agg(best).select("name", (-F.col("best.col2")).alias("power"))


@query()
def h04_yeo_johnson(spark, sf):
    return features.power_transform(use_all_cores(cut(X.features7(spark, sf))), SEVEN)


def scaled_sql(sd: str) -> str:
    return ", ".join(f"round(({c} - avg({c}) over ()) / {sd}({c}) over (), 6) + 0.0 as {c}" for c in SEVEN)


@query(sql(["features7"], f"select row_id, {scaled_sql('stddev_pop')} from features7"))
def h05_standardize(spark, sf):
    return features.standardize(X.features7(spark, sf), SEVEN).select("row_id", *[r6(c).alias(c) for c in SEVEN])


EIGEN = """cov as (select avg(f00) as mx, avg(f01) as my, var_pop(f00) as a, var_pop(f01) as c, covar_pop(f00, f01) as b from planted),
  eig as (select *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) as l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) as l2 from cov),
  vec as (select *, b / sqrt(b * b + pow(l1 - a, 2)) as u1, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) as v1,
    b / sqrt(b * b + pow(l2 - a, 2)) as u2, (l2 - a) / sqrt(b * b + pow(l2 - a, 2)) as v2 from eig),
  sgn as (select *, case when (case when abs(u1) > abs(v1) then u1 else v1 end) < 0 then -1 else 1 end as s1,
    case when (case when abs(u2) > abs(v2) then u2 else v2 end) < 0 then -1 else 1 end as s2 from vec)"""


@query(sql(["planted"], """
select row_id, round(s1 * ((f00 - mx) * u1 + (f01 - my) * v1), 6) + 0.0 as pca_1,
  round(s2 * ((f00 - mx) * u2 + (f01 - my) * v2), 6) + 0.0 as pca_2 from planted cross join sgn""", EIGEN))
def h06_pca(spark, sf):
    scores = features.pca(X.planted(spark, sf), TWO, 2)
    return scores.select("row_id", r6("pca_1").alias("pca_1"), r6("pca_2").alias("pca_2"))


@query(sql(["planted"], f"""
select 1 as component, {d6('l1 / (l1 + l2)')} as explained_ratio from eig
union all select 2, {d6('l2 / (l1 + l2)')} from eig""", EIGEN))
def h06_pca_variance(spark, sf):
    return features.pca_variance(X.planted(spark, sf), TWO, 2).withColumn("explained_ratio", r6("explained_ratio"))


@query()
def h06_pca_variance_wide(spark, sf):
    scaled = features.standardize(X.wide_features(spark, sf), WIDE)
    return features.pca_variance(scaled, WIDE, 2)


@query(sql(["features7"], f"select row_id, {scaled_sql('stddev_samp')} from features7"))
def h07_zscore(spark, sf):
    return features.zscore(X.features7(spark, sf), SEVEN).select("row_id", *[r6(c).alias(c) for c in SEVEN])


# --- I ----------------------------------------------------------------------


@query()
def i01_kmeans(spark, sf):
    return kmeans.kmeans(prepared(spark, sf), SEVEN, k=8).select("row_id", "cluster")


NUMBERED = """numbered as (select truth, cast(row_number() over (order by avg(f00), avg(f01)) - 1 as int) as cluster
  from separated group by truth)"""


@query(sql(["separated"], "select row_id, cluster from separated join numbered using (truth)", NUMBERED))
def i01_kmeans_separated(spark, sf):
    return kmeans.kmeans(X.separated(spark, sf), TWO, k=4).select("row_id", "cluster")


@query(sql(["long64"], f"""
select {d6('sum(n * v)')} as inertia from (
  select cluster, j, count(*) as n, var_pop(x) as v from long64 group by cluster, j)"""))
def i02_inertia(spark, sf):
    return validity.inertia(X.wide_features(spark, sf), WIDE).withColumn("inertia", r6("inertia"))


def partitions(groups: int) -> list[tuple[int, int, int, int]]:
    """All ways to put so many groups into two or more parts: ``(k, way, group, part)``."""
    ways = [[0]]
    for _ in range(groups - 1):
        ways = [[*w, p] for w in ways for p in range(max(w) + 2)]
    return [(max(w) + 1, i, g, p) for i, w in enumerate(ways) if max(w) for g, p in enumerate(w)]


@query(sql(["separated"], """
select k, round(min(inertia) / (select sum((f00 - x) ** 2 + (f01 - y) ** 2) from separated cross join (select avg(f00) as x, avg(f01) as y from separated)), 2) + 0.0 as share
from (select k, way, sum(inertia) as inertia from (
  select k, way, part, count(*) * (var_pop(f00) + var_pop(f01)) as inertia from separated join ways using (truth) group by k, way, part)
  group by k, way) group by k""", f"ways(k, way, truth, part) as (values {', '.join(map(str, partitions(4)))})"))
def i03_choose_k_separated(spark, sf):
    """Inertia of the best of all ways to join the four groups, as a share of all spread."""
    data = cut(X.separated(spark, sf))
    whole = validity.inertia(data.withColumn("cluster", F.lit(0)), TWO).scalar()
    return kmeans.choose_k(data, TWO, [2, 3, 4], tol=1e-12).select("k", (F.round(F.col("inertia") / whole, 2) + F.lit(0.0)).alias("share"))


@query()
def i03_choose_k(spark, sf):
    return kmeans.choose_k(prepared(spark, sf), SEVEN)


GAP7 = " + ".join(f"(p.f{j:02d} - o.f{j:02d}) * (p.f{j:02d} - o.f{j:02d})" for j in range(7))
GAP2 = "(p.f00 - o.f00) * (p.f00 - o.f00) + (p.f01 - o.f01) * (p.f01 - o.f01)"
SILHOUETTE = """drawn as (select * from labelled order by md5('42:' || cast(row_id as varchar)), row_id limit 5000),
  dist as (select p.row_id, p.cluster as own, o.cluster as other, count(*) as n, sum(GAP) as total
    from drawn p join drawn o on p.row_id <> o.row_id group by p.row_id, p.cluster, o.cluster),
  ab as (select row_id, max(total / n) filter (where other = own) as a, min(total / n) filter (where other <> own) as b
    from dist group by row_id),
  sil as (select avg(case when a is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end) as silhouette from ab)"""
PLANE_GAP = "sqrt((p.f00 - o.f00) * (p.f00 - o.f00) + (p.f01 - o.f01) * (p.f01 - o.f01))"
WIDE_GAP = "list_distance(p.v, o.v)"
PLANE = "labelled as (select row_id, truth as cluster, f00, f01 from planted)"
LISTED = "labelled as (select vec_id as row_id, label as cluster, cast(embedding as double[]) as v from embeddings)"


@query(sql(["planted"], f"select {d6('silhouette')} as silhouette from sil", f"{PLANE}, {SILHOUETTE.replace('GAP', PLANE_GAP)}"))
def i04_silhouette(spark, sf):
    labelled = X.planted(spark, sf).withColumnRenamed("truth", "cluster")
    return validity.silhouette(labelled, TWO).withColumn("silhouette", r6("silhouette"))


@query(sql([], f"select {d6('silhouette')} as silhouette from sil", f"{LISTED}, {SILHOUETTE.replace('GAP', WIDE_GAP)}"))
def i04_silhouette_wide(spark, sf):
    return validity.silhouette(X.wide_features(spark, sf), WIDE).withColumn("silhouette", r6("silhouette"))


@query(sql(["planted"], f"select {d6('silhouette')} as silhouette from sil",
    f"{PLANE}, {SILHOUETTE.replace('GAP', GAP2).replace(' limit 5000', '')}"))
def i04_silhouette_whole(spark, sf):
    """By squared distance, over all rows."""
    labelled = X.planted(spark, sf).withColumnRenamed("truth", "cluster")
    return validity.silhouette_squared(labelled, TWO).withColumn("silhouette", r6("silhouette"))


@query(sql([], f"select {d6('silhouette')} as silhouette from sil",
    f"{LISTED}, {SILHOUETTE.replace('GAP', WIDE_GAP + ' * ' + WIDE_GAP).replace(' limit 5000', '')}"))
def i04_silhouette_whole_wide(spark, sf):
    return validity.silhouette_squared(X.wide_features(spark, sf), WIDE).withColumn("silhouette", r6("silhouette"))


def davies_sql(source: str) -> str:
    """Index over a long table ``(row_id, cluster, j, x)``."""
    return f"""mean as (select cluster, j, avg(x) as m from {source} group by cluster, j),
  gaps as (select row_id, cluster, sqrt(sum((x - m) * (x - m))) as g from {source} join mean using (cluster, j) group by row_id, cluster),
  spread as (select cluster, avg(g) as s from gaps group by cluster),
  apart as (select a.cluster as a, b.cluster as b, sqrt(sum((a.m - b.m) * (a.m - b.m))) as d
    from mean a join mean b on a.j = b.j and a.cluster <> b.cluster group by a.cluster, b.cluster),
  db as (select avg(r) as davies_bouldin from (
    select a, max((x.s + y.s) / d) as r from apart join spread x on x.cluster = a join spread y on y.cluster = b group by a))"""


def calinski_sql(source: str) -> str:
    return f"""moments as (select cluster, j, count(*) as n, avg(x) as m, var_pop(x) as v from {source} group by cluster, j),
  overall as (select j, avg(x) as g from {source} group by j),
  sums as (select sum(n * (m - g) * (m - g)) as b, sum(n * v) as w, count(distinct cluster) as k from moments join overall using (j)),
  ch as (select (b / (k - 1)) / (w / ((select count(distinct row_id) from {source}) - k)) as calinski_harabasz from sums)"""


@query(sql(["long64"], f"select {d6('davies_bouldin')} as davies_bouldin from db", davies_sql("long64")))
def i05_davies_bouldin(spark, sf):
    return validity.davies_bouldin(X.wide_features(spark, sf), WIDE).withColumn("davies_bouldin", r6("davies_bouldin"))


@query(sql(["long64"], f"select {d6('calinski_harabasz')} as calinski_harabasz from ch", calinski_sql("long64")))
def i06_calinski_harabasz(spark, sf):
    return validity.calinski_harabasz(X.wide_features(spark, sf), WIDE).withColumn("calinski_harabasz", r6("calinski_harabasz"))


@query()
def i07_ward(spark, sf):
    return ward.ward(prepared(spark, sf), SEVEN, k=8).select("row_id", "cluster")


@query(sql(["separated"], "select row_id, cluster from separated join numbered using (truth)", NUMBERED))
def i07_ward_separated(spark, sf):
    return ward.ward(X.separated(spark, sf), TWO, k=4).select("row_id", "cluster")


@query()
def i07_ward_planted(spark, sf):
    return ward.ward(X.planted(spark, sf), TWO, k=4).select("row_id", "cluster")


EPS = [0.3, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0]


def density_sql(eps: list[float]) -> str:
    """Core points, components by smallest-label propagation, border points."""
    values = ", ".join(f"(cast({e} as double))" for e in eps)
    return f"""eps_list(eps) as (values {values}),
  near as (select eps, p.row_id as a, o.row_id as b from planted p join planted o
    on (p.f00 - o.f00) * (p.f00 - o.f00) + (p.f01 - o.f01) * (p.f01 - o.f01) <= {max(eps)} * {max(eps)}
    join eps_list on (p.f00 - o.f00) * (p.f00 - o.f00) + (p.f01 - o.f01) * (p.f01 - o.f01) <= eps * eps),
  core as (select eps, a as id from near group by eps, a having count(*) >= 10),
  links as (select n.eps, n.a, n.b from near n join core x on x.eps = n.eps and x.id = n.a join core y on y.eps = n.eps and y.id = n.b),
  lab(eps, id, l) using key (eps, id) as (
    select eps, id, id from core
    union
    select k.eps, k.b, min(t.l) from lab t join links k on k.eps = t.eps and k.a = t.id
      join recurring.lab cur on cur.eps = k.eps and cur.id = k.b group by k.eps, k.b, cur.l having min(t.l) < cur.l),
  numbered as (select eps, id, dense_rank() over (partition by eps order by l) - 1 as cluster from lab),
  border as (select n.eps, n.a as id, min(c.cluster) as cluster from near n join numbered c on c.eps = n.eps and c.id = n.b
    where (n.eps, n.a) not in (select (eps, id) from core) group by n.eps, n.a),
  labels as (select e.eps, p.row_id, cast(coalesce(c.cluster, b.cluster, -1) as int) as cluster from planted p cross join eps_list e
    left join numbered c on c.eps = e.eps and c.id = p.row_id left join border b on b.eps = e.eps and b.id = p.row_id)"""


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    return cut(features.standardize(X.features7(spark, sf), SEVEN))


def recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


@query(recursive(sql(["planted"], "select row_id, cluster from labels", density_sql([0.5]))))
def i08_dbscan(spark, sf):
    return dbscan.dbscan(X.planted(spark, sf), TWO, 0.5).select("row_id", "cluster")


@query(recursive(sql(["scaled7"], "select row_id, cluster from labels", density_sql([1.0]).replace(GAP2, GAP7).replace("planted", "scaled7"))))
def i08_dbscan_scaled(spark, sf):
    return dbscan.dbscan(scaled(spark, sf), SEVEN, 1.0).select("row_id", "cluster")


@query()
def i08_dbscan_features(spark, sf):
    return dbscan.dbscan(prepared(spark, sf), SEVEN, 1.0).select("row_id", "cluster")


@query(recursive(sql(["planted"], """
select eps, n_clusters, noise, noise_pct, valid and row_number() over (order by valid desc, noise, eps) = 1 as chosen from counted""",
    density_sql(EPS) + f""", counted as (
  select eps, count(distinct cluster) filter (where cluster <> -1) as n_clusters, count(*) filter (where cluster = -1) as noise,
    {d6('100.0 * count(*) filter (where cluster = -1) / count(*)')} as noise_pct,
    count(distinct cluster) filter (where cluster <> -1) >= 2 and count(*) filter (where cluster = -1) < count(*) as valid
  from labels group by eps)""")))
def i09_dbscan_sweep(spark, sf):
    labels = dbscan.dbscan_sweep(X.planted(spark, sf), TWO, EPS)
    return dbscan.sweep_summary(labels).withColumn("noise_pct", r6("noise_pct"))


def with_noise(spark, sf) -> DataFrame:
    """Planted groups with the far points as noise."""
    far = (F.col("row_id") % 1500) % 101 == 100
    return X.planted(spark, sf).withColumn("cluster", F.when(far, -1).otherwise(F.col("truth"))).drop("truth")


NOISY = """marked as (select row_id, case when (row_id % 1500) % 101 = 100 then -1 else truth end as cluster, f00, f01 from planted),
  labelled as (select * from marked where cluster <> -1),
  tall as (select row_id, cluster, 0 as j, f00 as x from labelled union all select row_id, cluster, 1, f01 from labelled)"""


@query(sql(["planted"], f"""
select 'given groups' as method, cast(count(distinct cluster) filter (where cluster <> -1) as int) as n_clusters,
  count(*) filter (where cluster = -1) as noise_points, {d6('(select silhouette from sil)')} as silhouette,
  {d6('(select davies_bouldin from db)')} as davies_bouldin, {d6('(select calinski_harabasz from ch)')} as calinski_harabasz
from marked""", ", ".join([NOISY, SILHOUETTE.replace("GAP", PLANE_GAP), davies_sql("tall"), calinski_sql("tall")])))
def i10_evaluate_clustering(spark, sf):
    out = validity.evaluate_clustering(with_noise(spark, sf), TWO, "given groups")
    return out.withColumns({c: r6(c) for c in ("silhouette", "davies_bouldin", "calinski_harabasz")})


@query("select label as cluster, count(*) as n from embeddings group by label")
def i11_cluster_sizes(spark, sf):
    return validity.cluster_sizes(X.wide_features(spark, sf))


@query(sql(["flagged"], """
select row_id, cluster, name from flagged
where cluster = (select cluster from flagged group by cluster order by count(*), cluster limit 1) order by row_id limit 10"""))
def i12_smallest_cluster_examples(spark, sf):
    return validity.smallest_cluster_examples(X.flagged(spark, sf), "name")


@query(sql(["long64"], f"""
select cluster, side, cast(rank as int) as rank, 'f' || lpad(cast(j as varchar), 2, '0') as indicator, {d6('z')} as z from (
  select *, 'elevated' as side, row_number() over (partition by cluster order by z desc, j) as rank from profile
  union all select *, 'depressed', row_number() over (partition by cluster order by z, j) from profile) where rank <= 5""",
    """scaled as (select cluster, j, (x - avg(x) over (partition by j)) / stddev_samp(x) over (partition by j) as z from long64),
  profile as (select cluster, j, avg(z) as z from scaled group by cluster, j)"""))
def i13_cluster_profile(spark, sf):
    return validity.cluster_profile(X.wide_features(spark, sf), WIDE).withColumn("z", r6("z"))


@query(sql(["flagged"], """
select cluster, string_agg(name, '|' order by first) as examples from (
  select cluster, name, min(row_id) as first, row_number() over (partition by cluster order by min(row_id)) as rank
  from flagged group by cluster, name) where rank <= 3 group by cluster"""))
def i14_cluster_examples(spark, sf):
    out = validity.cluster_examples(X.flagged(spark, sf), "name")
    return out.withColumn("examples", F.concat_ws("|", "examples"))


@query(sql(["long64"], """
select s.cluster, n, examples, elevated, depressed from sizes s join shown using (cluster) join extremes using (cluster)""",
    """sizes as (select label as cluster, count(*) as n from embeddings group by label),
  named as (select vec_id as row_id, label as cluster, 'v' || cast(vec_id % 37 as varchar) as name from embeddings),
  shown as (select cluster, string_agg(name, '|' order by first) as examples from (
    select cluster, name, min(row_id) as first, row_number() over (partition by cluster order by min(row_id)) as rank
    from named group by cluster, name) where rank <= 3 group by cluster),
  scaled as (select cluster, j, (x - avg(x) over (partition by j)) / stddev_samp(x) over (partition by j) as z from long64),
  profile as (select cluster, j, avg(z) as z from scaled group by cluster, j),
  ranked as (select *, row_number() over (partition by cluster order by z desc, j) as up,
    row_number() over (partition by cluster order by z, j) as down, 'f' || lpad(cast(j as varchar), 2, '0') as indicator from profile),
  extremes as (select cluster, string_agg(indicator, '|' order by up) filter (where up <= 5) as elevated,
    string_agg(indicator, '|' order by down) filter (where down <= 5) as depressed from ranked group by cluster)"""))
def i14_cluster_block(spark, sf):
    named = X.wide_features(spark, sf).withColumn("name", F.concat(F.lit("v"), (F.col("row_id") % 37).cast("string")))
    out = validity.cluster_block(named, WIDE, "name")
    return out.withColumns({c: F.concat_ws("|", c) for c in ("examples", "elevated", "depressed")})


def clusterings(spark, sf) -> dict[str, DataFrame]:
    data = prepared(spark, sf)
    labels = cut(dbscan.dbscan_sweep(data, SEVEN, EPS))
    best = [r["eps"] for r in dbscan.sweep_summary(labels).filter("chosen").collect()]
    out = {"kmeans": cut(kmeans.kmeans(data, SEVEN, 8)), "agglomerative": cut(ward.ward(data, SEVEN, 8))}
    if best:
        out["dbscan"] = labels.filter(F.col("eps") == best[0]).drop("eps")
    return out


@query(sql(["separated"], """
select cluster, 'kmeans' as method, count(*) as n from separated join numbered using (truth) group by cluster
union all select cluster, 'agglomerative', count(*) from separated join numbered using (truth) group by cluster""", NUMBERED))
def i16_label_table_separated(spark, sf):
    data = X.separated(spark, sf)
    table = validity.label_table({"kmeans": kmeans.kmeans(data, TWO, 4), "agglomerative": ward.ward(data, TWO, 4)})
    long = table.unpivot(["row_id"], ["kmeans", "agglomerative"], "method", "cluster")
    return long.groupBy("cluster", "method").agg(F.count("*").alias("n"))


@query(sql(["separated", "activities"], """
select a.geography, n.cluster as kmeans, n.cluster as agglomerative, count(*) as n
from separated s join numbered n using (truth) join activities a on a.activity_uuid = s.row_id group by all""", NUMBERED))
def i16_label_table_metadata(spark, sf):
    data = X.separated(spark, sf)
    about = X.activities(spark, sf).select(F.col("activity_uuid").alias("row_id"), "activity_name", "geography")
    labels = {"kmeans": kmeans.kmeans(data, TWO, 4), "agglomerative": ward.ward(data, TWO, 4)}
    table = validity.label_table(labels, about=about)
    return table.groupBy("geography", "kmeans", "agglomerative").agg(F.count("*").alias("n"))


OUTSIDE = "greatest(abs(f00 - 5.5), abs(f01 - 5.5)) > 15"


@query(sql(["planted"], f"""
select 'rows where kind = ' || kind as "check", count(*) as written, count(*) as expected, true as ok
from (select case when {OUTSIDE} then 'far and flagged' else 'near' end as kind from planted) group by kind
union all select 'rows', count(*), count(*), true from planted
union all select 'columns of the same type', 10, 10, true"""))
def p01_labelled_profile(spark, sf):
    """Cluster, outlier flag and component scores beside the metadata, in one table, written and read back.

    On a table with outliers, every one of which has to be flagged.
    """
    data = cut(X.planted(spark, sf).drop("truth"))
    groups = kmeans.kmeans(data, TWO, 4).select("row_id", "cluster")
    flags = anomaly.flag_top(cut(anomaly.isolation_forest(data, TWO)), "score")
    scores = features.pca(data, TWO, 2).select("row_id", "pca_1", "pca_2")
    about = X.activities(spark, sf).select(F.col("activity_uuid").alias("row_id"), "activity_name", "geography")
    far = F.expr(OUTSIDE)
    kind = F.when(far & F.col("is_anomaly"), "far and flagged").when(far, "far and missed").otherwise("near").alias("kind")
    whole = groups.join(flags, "row_id").join(scores, "row_id").join(about, "row_id").join(data, "row_id")
    whole = cut(whole.select("*", kind).drop("f01"))
    path = new_folder(spark, "profile")
    tables.save_table(whole, path)
    return tables.verify_sink(whole, path, "kind")


GIVEN = {"given groups": "truth", "halves": "truth % 2", "far rows as noise": "case when row_id % 101 = 100 then -1 else truth end"}
COMPARED = " union all ".join(
    f"""select * from (with marked as (select row_id, {label} as cluster, f00, f01 from planted),
  labelled as (select * from marked where cluster <> -1),
  tall as (select row_id, cluster, 0 as j, f00 as x from labelled union all select row_id, cluster, 1, f01 from labelled),
  {SILHOUETTE.replace("GAP", PLANE_GAP)}, {davies_sql("tall")}, {calinski_sql("tall")}
  select '{method}' as method, cast(count(distinct cluster) filter (where cluster <> -1) as int) as n_clusters,
    count(*) filter (where cluster = -1) as noise_points, {d6('(select silhouette from sil)')} as silhouette,
    {d6('(select davies_bouldin from db)')} as davies_bouldin, {d6('(select calinski_harabasz from ch)')} as calinski_harabasz from marked)"""
    for method, label in GIVEN.items()
)


@query(sql(["planted"], COMPARED))
def i15_compare_given(spark, sf):
    """Three labellings of the same rows beside each other."""
    data = X.planted(spark, sf)
    out = validity.compare_clusterings({m: data.withColumn("cluster", F.expr(label).cast("int")) for m, label in GIVEN.items()}, TWO)
    return out.withColumns({c: r6(c) for c in ("silhouette", "davies_bouldin", "calinski_harabasz")})


@query()
def i15_compare_clusterings(spark, sf):
    return validity.compare_clusterings(clusterings(spark, sf), SEVEN, sample=None)


@query()
def i16_label_table(spark, sf):
    return validity.label_table(clusterings(spark, sf))


# --- J ----------------------------------------------------------------------


@query()
def j01_isolation_forest(spark, sf):
    return anomaly.isolation_forest(prepared(spark, sf), SEVEN)


@query(sql(["planted"], f"select count(*) filter (where {OUTSIDE}) as far, count(*) filter (where {OUTSIDE}) as far_on_top from planted"))
def j01_isolation_far(spark, sf):
    """Every point well outside the square of the groups is among the 2 % of highest scores."""
    data = X.planted(spark, sf)
    scores = anomaly.flag_top(cut(anomaly.isolation_forest(data, TWO)), "score").join(data.select("row_id", *TWO), "row_id")
    far = F.expr(OUTSIDE)
    return scores.agg(F.count_if(far).alias("far"), F.count_if(far & F.col("is_anomaly")).alias("far_on_top"))


@query("""
select event_id, value > (select quantile_cont(value, 0.98) from events) as is_anomaly from events""")
def j02_flag_top(spark, sf):
    return anomaly.flag_top(X.table(spark, sf, "events"), "value").select("event_id", "is_anomaly")


LOF_SQL = f"""vec as (select *, min(row_id) over (partition by f00, f01) as uid from planted),
  near as (select * from (
    select p.row_id, o.row_id as other, {PLANE_GAP} as dist, row_number() over (partition by p.row_id order by
      (p.f00 - o.f00) * (p.f00 - o.f00) + (p.f01 - o.f01) * (p.f01 - o.f01), o.uid, o.row_id) as rank
    from vec p join vec o on p.row_id <> o.row_id) where rank <= 20),
  far as (select row_id, max(dist) as k_dist from near group by row_id),
  dens as (select n.row_id, 1 / (avg(greatest(n.dist, f.k_dist)) + 1e-10) as density
    from near n join far f on f.row_id = n.other group by n.row_id)"""


@query(sql(["planted"], f"""
select n.row_id, {d6('avg(o.density / p.density)')} as lof from near n
join dens p on p.row_id = n.row_id join dens o on o.row_id = n.other group by n.row_id""", LOF_SQL))
def j03_lof(spark, sf):
    return anomaly.lof(X.planted(spark, sf), TWO).withColumn("lof", r6("lof"))


@query(sql(["scaled7"], f"""
select n.row_id, {d6('avg(o.density / p.density)')} as lof from near n
join dens p on p.row_id = n.row_id join dens o on o.row_id = n.other group by n.row_id""",
    LOF_SQL.replace(GAP2, GAP7).replace("partition by f00, f01", f"partition by {', '.join(SEVEN)}").replace("planted", "scaled7")))
def j03_lof_scaled(spark, sf):
    return anomaly.lof(scaled(spark, sf), SEVEN).withColumn("lof", r6("lof"))


@query()
def j03_lof_features(spark, sf):
    return anomaly.lof(prepared(spark, sf), SEVEN)


COUNTS = """count(*) filter (where flag_a and flag_b) as "both", count(*) filter (where flag_a and not flag_b) as only_a,
  count(*) filter (where not flag_a and flag_b) as only_b"""


@query(sql(["flagged"], f"select {COUNTS}, count(*) filter (where not flag_a and not flag_b) as neither from flagged"))
def j04_flag_contingency(spark, sf):
    return anomaly.flag_contingency(X.flagged(spark, sf), "flag_a", "flag_b")


@query(sql(["flagged"], f"""
select "both" + only_a as flagged_a, "both" + only_b as flagged_b, "both", only_a, only_b,
  {d6('coalesce(100.0 * "both" / nullif("both" + only_a, 0), 0)')} as pct_a_confirmed,
  {d6('coalesce(100.0 * "both" / nullif("both" + only_b, 0), 0)')} as pct_b_confirmed,
  {d6('coalesce("both" / nullif("both" + only_a + only_b, 0), 0)')} as jaccard
from (select {COUNTS} from flagged)"""))
def j05_flag_agreement(spark, sf):
    out = anomaly.flag_agreement(X.flagged(spark, sf), "flag_a", "flag_b")
    return out.withColumns({c: r6(c) for c in ("pct_a_confirmed", "pct_b_confirmed", "jaccard")})


@query()
def j05_detector_agreement(spark, sf):
    data = prepared(spark, sf)
    forest = cut(anomaly.isolation_forest(data, SEVEN))
    factor = cut(anomaly.lof(data, SEVEN))
    both = anomaly.flag_top(forest, "score", out="iso").join(anomaly.flag_top(factor, "lof", out="lof_flag"), "row_id")
    return anomaly.flag_agreement(both, "iso", "lof_flag")


@query(sql(["flagged"], "select row_id, cluster, name from flagged where flag_a and flag_b order by row_id limit 10"))
def j06_consensus(spark, sf):
    return anomaly.consensus(X.flagged(spark, sf), "flag_a", "flag_b").select("row_id", "cluster", "name")


SMALL = """marked as (select *, count(*) over (partition by cluster) < 0.1 * count(*) over () as in_small_cluster from flagged)"""


@query(sql(["flagged"], "select row_id, cluster, in_small_cluster from marked", SMALL))
def j07_small_clusters(spark, sf):
    return anomaly.small_clusters(X.flagged(spark, sf), 0.1).select("row_id", "cluster", "in_small_cluster")


@query(sql(["flagged"], """
select flag_a, count(*) filter (where not in_small_cluster) as in_small_cluster_false,
  count(*) filter (where in_small_cluster) as in_small_cluster_true from marked group by flag_a""", SMALL))
def j08_crosstab(spark, sf):
    return anomaly.crosstab(anomaly.small_clusters(X.flagged(spark, sf), 0.1), "flag_a", "in_small_cluster")


@query(sql(["flagged"], f"""
select n_small, n_anomaly, overlap, {d6('100.0 * overlap / nullif(n_small, 0)')} as pct_small_flagged,
  {d6('100.0 * overlap / nullif(n_anomaly, 0)')} as pct_anomaly_in_small
from (select count(*) filter (where in_small_cluster) as n_small, count(*) filter (where flag_a) as n_anomaly,
  count(*) filter (where in_small_cluster and flag_a) as overlap from marked)""", SMALL))
def j09_coverage(spark, sf):
    out = anomaly.coverage(anomaly.small_clusters(X.flagged(spark, sf), 0.1), "flag_a")
    return out.withColumns({c: r6(c) for c in ("pct_small_flagged", "pct_anomaly_in_small")})


@query(sql(["flagged"], "select row_id, name, cluster from flagged where flag_a order by row_id limit 10"))
def j10_anomaly_extract(spark, sf):
    return anomaly.anomaly_extract(X.flagged(spark, sf), ["name", "cluster"], flag="flag_a")
