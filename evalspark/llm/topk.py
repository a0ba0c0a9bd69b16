"""Exact top-k by inner product: aggregation of sorted lists without random access.

Candidates are dealt into blocks of about ``block`` rows, queries likewise. A task has
one block of each. It sorts the candidates by every dimension once; for a batch of
queries it then reads all lists from their better ends, to a depth that doubles from
round to round. Every candidate has a lower and an upper bound of its score: what was
read counts in full, what was not lies between the list's last value and the value at
the present depth. A query stops when only few candidates can still reach its k-th
lower bound; their scores are then resolved. The best k of each block meet in a ranking.

Dense lists keep the lower bounds of a single block far apart from its upper ones, so the
blocks are searched in two passes. The first one takes the square root of their number;
the k-th final score that a query has found there bounds it from below in all the others,
where outsiders are ruled out long before the lists end and only candidates that reach
the bound are returned.

No block grows with the table. The number of pairs of blocks does, as is the nature of
a search of a share of all rows against all rows; the rows returned per query grow with
the square root of the number of blocks.

Defined results: vectors that are null or hold null or non-finite components take no
part, nor do rows without an id; shorter vectors count as filled up with zeros; a
repeated id asks once (with its smallest vector), and its rows are candidates of each
other query, one by one; fewer than k candidates give as many ranks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.plans.storage import cut

OUT = "query_id long, vec_id long, score long"
STEPS = 8  # a round reads this part of the lists, from half of them on


def quantised(vector: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` of each component; null for a vector that takes no part."""
    good = F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(t: pa.Table, dims: int) -> np.ndarray:
    lists = t.column("vector").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, dtype=np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return values.reshape(len(lists), dims)
    full = np.zeros((len(lists), dims), dtype=np.int64)
    full[np.arange(dims) < lengths[:, None]] = values
    return full


def _kind(v: np.ndarray, q: np.ndarray):
    """The smallest number type in which every sum is exact."""
    most = float(np.abs(v.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(1, v.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def search_block(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
    bounds: np.ndarray | None = None, batch: int = 256, slack: int = 4, depths: list | None = None,
) -> list[tuple]:
    """``(query_id, vec_id, score)`` of the best k of a block for each query.

    ``bounds`` holds a score per query that the k-th best of all candidates is known to
    reach; candidates below it are left out. ``depths`` collects the share of the lists
    that was read when a query stopped.
    """
    n, d = vectors.shape
    if bounds is None:
        bounds = np.full(len(queries), -np.inf)
    kind = _kind(vectors, queries)
    v = vectors.astype(kind)
    if n <= slack * k or d == 0 or kind is object:
        found = _resolved_all(ids, v, query_ids, queries.astype(kind), k)
        floor = dict(zip(query_ids.tolist(), bounds.tolist()))
        return [f for f in found if f[2] >= floor[int(f[0])]]
    order = np.argsort(v, axis=0, kind="stable")  # a list per dimension, read from its end or from its start
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n)[:, None], (n, d)), axis=0)
    low, high = v.min(axis=0), v.max(axis=0)
    out: list[tuple] = []
    left = np.arange(len(queries))
    depth = max(1, n // 2)
    while len(left):
        known_down, known_up = place >= n - depth, place < depth
        bottom = np.take_along_axis(v, order[n - depth][None, :], axis=0)[0]
        top = np.take_along_axis(v, order[depth - 1][None, :], axis=0)[0]
        upper = np.hstack([np.where(known_down, v, bottom), np.where(known_up, v, top)]).T
        lower = np.hstack([np.where(known_down, v, low), np.where(known_up, v, high)]).T
        going = []
        for part in np.array_split(left, math.ceil(len(left) / batch)):
            q = queries[part].astype(kind)
            weights = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
            least = weights @ lower
            most = least if depth == n else weights @ upper
            own = query_ids[part][:, None] == ids[None, :]
            least[own] = -np.inf
            most[own] = -np.inf
            kth = np.maximum(np.partition(least, n - k, axis=1)[:, n - k], bounds[part])
            able = (most >= kth[:, None]) & ~own
            done = (able.sum(axis=1) <= slack * k) | (depth == n)
            for i in np.flatnonzero(done):
                some = np.flatnonzero(able[i])
                scores = v[some] @ q[i]
                best = np.lexsort((ids[some], -scores))[:k]
                best = best[scores[best] >= bounds[part[i]]]
                out.extend(zip([query_ids[part[i]]] * len(best), ids[some[best]], scores[best]))
                if depths is not None:
                    depths.append(depth / n)
            going.append(part[~done])
        left = np.concatenate(going)
        depth = min(n, depth + max(1, n // STEPS))
    return out


def _resolved_all(ids, v, query_ids, queries, k) -> list[tuple]:
    out: list[tuple] = []
    for i, own in enumerate(query_ids):
        scores = v @ queries[i] if v.shape[1] else np.zeros(len(v))
        some = np.flatnonzero(ids != own)
        best = some[np.lexsort((ids[some], -scores[some].astype(object if scores.dtype == object else np.float64)))[:k]]
        out.extend((own, ids[j], scores[j]) for j in best)
    return out


def top_k(rows: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 20, scale: int = 64, block: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of each query row, ties to the smaller id."""
    usable = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("vector"), is_query.alias("asks")
    ).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    queries = usable.filter("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    n, asking, dims = usable.agg(F.count("*"), F.count_if("asks"), F.max(F.size("vector"))).first()
    deal, ask, dims = max(1, math.ceil(n / block)), max(1, math.ceil(asking / (2 * block))), dims or 0
    first = math.isqrt(deal)

    def part(c: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")

    def search(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        found = []
        if len(candidates) and len(wanted):
            ids, query_ids = candidates.column("vec_id").to_numpy(), wanted.column("query_id").to_numpy()
            bounds = np.array([-np.inf if b is None or abs(b) >= 2**53 else float(b) for b in wanted.column("bound").to_pylist()])
            found = search_block(ids, _matrix(candidates, dims), query_ids, _matrix(wanted, dims), k, bounds)
        columns = zip(*found) if found else ([], [], [])
        return pa.table({name: pa.array([int(x) for x in c], pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), columns)})

    def searched(asked: DataFrame, start: int, end: int) -> DataFrame:
        """Each query against the candidates of the blocks from ``start`` up to ``end``."""
        narrow, c = F.transform("vector", lambda x: x.cast("long")).alias("vector"), part("vec_id", deal)
        every = F.explode(F.sequence(F.lit(0), F.lit(ask - 1))).alias("q")
        blocks = usable.select("vec_id", "vector", c.alias("c")).filter(F.col("c").between(start, end - 1)).select("c", every, "vec_id", narrow)
        wanted = asked.select(F.explode(F.sequence(F.lit(start), F.lit(end - 1))).alias("c"), part("query_id", ask).alias("q"), "query_id", narrow, "bound")
        return blocks.groupBy("c", "q").cogroup(wanted.groupBy("c", "q")).applyInArrow(search, OUT)

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    place = F.row_number().over(by_score).alias("rank")
    found = searched(queries.withColumn("bound", F.lit(None).cast("long")), 0, first)
    if first < deal:
        found = cut(found.select("*", place).filter(F.col("rank") <= k).drop("rank"))
        reached = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bound"))
        reached = reached.select("query_id", F.when(F.col("n") >= k, F.col("bound")).alias("bound"))
        found = found.unionByName(searched(queries.join(reached, "query_id", "left"), first, deal))
    return found.select("*", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
