"""Codes of vectors from integer codebooks, fitted by dual-tree Lloyd rounds.

Components become integers ``floor(scale * x)`` and a vector is cut into equal parts.
Every part position has a codebook, which starts as that part of the vectors of the
smallest ids. A round assigns each part to its nearest entry (squared Euclidean
distance, ties to the lower index) and replaces each entry by the floored mean of its
parts; an entry without parts stays. After the last round the parts are assigned again.

How a block of vectors is assigned: equal parts are one point with a weight. A tree over
the points and a tree over the entries hold the box of each node, the point tree also the
weight and the sum of the components. Pairs of a point node and an entry node are
refined together, from both roots on. An entry node whose box is farther from a point
node's box than the farthest corners of another are from each other holds no nearest
entry, and the pair is dropped. Once one entry is left for a point node, the whole node
is assigned and its cached sums go to the entry. Leaves of points for which several
entries remain are settled point by point on the integers. All distances are integers,
so the bounds are exact and ties are never lost.

A task holds one block of vectors, an Arrow batch. It returns one sum per part position and entry, which
meet in a partial aggregate; the driver holds the codebooks alone, a number of entries
that the parameters bound.

Defined results: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as filled up with zeros, as do lengths that the parts don't divide;
components beyond a 64-bit integer saturate; of fewer vectors than entries each makes one;
null ids come last, equal ids start in the order of their components; repeated rows are
coded each for itself; an error too large for a 64-bit integer is null, and so is the sum
that holds one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import fresh
from evalspark.llm.topk import quantised
from evalspark.plans.joins import lookup_join
from evalspark.plans.storage import cut

LEAF = 4  # points in a leaf, at most
SAFE = 1 << 26  # up to here all sums of a block fit 64 bits
LONGEST = (1 << 63) - 1


@dataclass
class Tree:
    """A balanced tree over weighted points: node ``i`` has children ``2i + 1`` and ``2i + 2``.

    ``order`` lists the points so that those of a node lie in ``first[i]:last[i]``.
    """

    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray
    levels: int

    def leaf(self, nodes: np.ndarray) -> np.ndarray:
        return nodes >= (1 << (self.levels - 1)) - 1


def grow(x: np.ndarray, leaf: int) -> Tree:
    """Halve the points at the median of their widest component until ``leaf`` are left."""
    n = len(x)
    levels = 1
    while n > leaf << (levels - 1):
        levels += 1
    order = np.arange(n)
    edges = np.array([0, n])
    firsts, lasts, lows, highs = [], [], [], []
    for level in range(levels):
        first, last = edges[:-1], edges[1:]
        y = x[order]
        filled = last > first
        low = np.zeros((len(first), x.shape[1]), dtype=x.dtype)
        high = low.copy()
        # Empty nodes occur only among the last levels of very small tables.
        low[filled] = np.minimum.reduceat(y, first[filled], axis=0) if filled.any() else 0
        high[filled] = np.maximum.reduceat(y, first[filled], axis=0) if filled.any() else 0
        for kept, new in ((firsts, first), (lasts, last), (lows, low), (highs, high)):
            kept.append(new)
        if level + 1 < levels:
            node = np.repeat(np.arange(len(first)), last - first)
            widest = (high - low).argmax(axis=1)
            order = order[np.lexsort((y[np.arange(n), widest[node]], node))]
            edges = np.sort(np.concatenate([edges, (first + last + 1) // 2]))
    return Tree(order, *(np.concatenate(a) for a in (firsts, lasts, lows, highs)), levels)


def nearest(x: np.ndarray, weight: np.ndarray, entries: np.ndarray, counted: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each point's entry, and each entry's weight and sum of components; all integers.

    ``counted`` collects how many pairs of nodes were bounded, and how many points were
    settled with their node and by themselves.
    """
    k, d = entries.shape
    points, words = grow(x, LEAF), grow(entries, 1)
    held = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(weight[points.order])])
    summed = np.concatenate([np.zeros((1, d), dtype=np.int64), np.cumsum((x * weight[:, None])[points.order], axis=0)])
    label = np.empty(len(x), dtype=np.int64)  # in the order of the tree
    weights, sums = np.zeros(k, dtype=np.int64), np.zeros((k, d), dtype=np.int64)
    counted = {} if counted is None else counted
    counted |= {c: counted.get(c, 0) for c in ("pairs", "whole", "alone")}
    q, e = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)  # pairs of nodes, ordered by q
    while len(q):
        counted["pairs"] += len(q)
        near, far = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64)
        for c in range(d):
            below, above = points.low[q, c] - words.high[e, c], words.low[e, c] - points.high[q, c]
            near += np.maximum(np.maximum(below, above), 0) ** 2
            far += np.maximum(-below, -above) ** 2
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        sizes = np.diff(np.append(starts, len(q)))
        stays = near <= np.repeat(np.minimum.reduceat(far, starts), sizes)
        q, e, lone = q[stays], e[stays], np.add.reduceat(stays, starts) == 1
        single = words.leaf(e)
        alone = np.repeat(lone, np.add.reduceat(stays, starts)) & single
        if alone.any():  # the whole node at once
            at, entry = q[alone], words.order[words.first[e[alone]]]
            a, b = points.first[at], points.last[at]
            np.add.at(weights, entry, held[b] - held[a])
            np.add.at(sums, entry, summed[b] - summed[a])
            run = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
            label[run] = np.repeat(entry, b - a)
            counted["whole"] += len(run)
            q, e, single = q[~alone], e[~alone], single[~alone]
        if not len(q):
            break
        stuck = points.leaf(q)
        ready = stuck & single
        if ready.any():  # leaves all of whose entries are single; a leaf's entries lie on two levels at most
            starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            sizes = np.diff(np.append(starts, len(q)))
            ready = np.repeat(np.logical_and.reduceat(ready, starts), sizes)
        if ready.any():
            run, entry = _settled(x, points, entries, q[ready], words.order[words.first[e[ready]]])
            label[run] = entry
            own = points.order[run]
            np.add.at(weights, entry, weight[own])
            np.add.at(sums, entry, x[own] * weight[own, None])
            counted["alone"] += len(run)
            q, e, single, stuck = q[~ready], e[~ready], single[~ready], stuck[~ready]
        q, e = _split(points, words, q, e, stuck, single)
    out = np.empty(len(x), dtype=np.int64)
    out[points.order] = label
    return out, weights, sums


def _split(points: Tree, words: Tree, q: np.ndarray, e: np.ndarray, stuck: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children; a leaf stands for itself, and nodes without points are left out."""
    q = np.stack([np.where(stuck, q, 2 * q + 1), np.where(stuck, -1, 2 * q + 2)], axis=1)
    e = np.stack([np.where(single, e, 2 * e + 1), np.where(single, -1, 2 * e + 2)], axis=1)
    q, e = np.repeat(q, 2, axis=1).ravel(), np.tile(e, (1, 2)).ravel()
    real = (q >= 0) & (e >= 0)
    q, e = q[real], e[real]
    real = (points.last[q] > points.first[q]) & (words.last[e] > words.first[e])
    q, e = q[real], e[real]
    by_node = np.argsort(q, kind="stable")
    return q[by_node], e[by_node]


def _settled(x: np.ndarray, points: Tree, entries: np.ndarray, q: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and nearest entries of the points of leaves ``q``, each beside the entries left for it."""
    size = points.last[q] - points.first[q]
    start = np.cumsum(size) - size
    run = np.repeat(points.first[q] - start, size) + np.arange(size.sum())
    entry = np.repeat(entry, size)
    own = x[points.order[run]]
    apart = np.zeros(len(run), dtype=np.int64)
    for c in range(x.shape[1]):
        apart += (own[:, c] - entries[entry, c]) ** 2
    best = np.lexsort((entry, apart, run))
    best = best[np.concatenate([[True], run[best][1:] != run[best][:-1]])]
    return run[best], entry[best]


def _nearest_large(x: np.ndarray, weight: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same on numbers of any size, entry by entry; for blocks with components beyond ``SAFE``."""
    x, entries = x.astype(object), entries.astype(object)
    label, best = np.zeros(len(x), dtype=np.int64), None
    for i, c in enumerate(entries):
        apart = ((x - c) ** 2).sum(axis=1)
        closer = np.ones(len(x), dtype=bool) if best is None else (apart < best).astype(bool)
        label[closer] = i
        best = apart if best is None else np.where(closer, apart, best)
    weights, sums = np.zeros(len(entries), dtype=np.int64), np.zeros(entries.shape, dtype=object)
    np.add.at(weights, label, weight)
    np.add.at(sums, label, x * weight.astype(object)[:, None])
    return label, weights, sums


def _safe(*arrays: np.ndarray) -> bool:
    """Whether distances and sums of these integers fit 64 bits."""
    return all(abs(int(v)) <= SAFE for a in arrays for v in (a.min(), a.max()))


def assigned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each part's entry, and each entry's number of parts and sum of components."""
    kinds, back, weight = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    label, weights, sums = (nearest if _safe(x, entries) else _nearest_large)(kinds, weight, entries)
    return label[back.ravel()], weights, sums


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        lists = b.column(column)
        lengths = np.diff(lists.offsets.to_numpy())
        full = np.zeros((len(lists), dims), dtype=np.int64)
        full[np.arange(dims) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        yield b, full


def fit(vectors: DataFrame, id_col: str, vector: str, dims: int, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """Codebooks, as integers by part, entry and component, of vectors already quantised."""
    start = vectors.orderBy(F.col(id_col).asc_nulls_last(), vector).limit(entries).select(vector).collect()
    width = dims // parts
    books = np.zeros((parts, len(start), width), dtype=np.int64)
    for i, row in enumerate(start):
        books[:, i] = np.array(row[0] + [0] * (dims - len(row[0])), dtype=np.int64).reshape(parts, width)
    for _ in range(rounds if len(start) else 0):
        books = _improved(vectors.select(vector), vector, dims, books)
    return books


def _improved(vectors: DataFrame, vector: str, dims: int, books: np.ndarray) -> np.ndarray:
    parts, k, width = books.shape
    whole = pa.decimal128(38, 0)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per part position, entry and task: the number of parts and their sums."""
        weights, sums = np.zeros((parts, k), dtype=object), np.zeros((parts, k, width), dtype=object)
        for _, x in _blocks(batches, dims, vector):
            if len(x):
                for p in range(parts):
                    _, w, s = assigned(x[:, p * width : (p + 1) * width], books[p])
                    weights[p] += w
                    sums[p] += s
        p, e = np.nonzero(weights)
        values = [[int(v) for v in sums[i, j]] for i, j in zip(p, e)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array([int(w) for w in weights[p, e]], pa.int64()), pa.array(values, pa.list_(whole))],
            ["part", "entry", "n", "sums"],
        )

    found = vectors.mapInArrow(summed, "part int, entry int, n long, sums array<decimal(38,0)>")
    total = [F.sum(F.col("sums")[c]).alias(f"s{c}") for c in range(width)]
    books = books.copy()
    for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # parts * entries rows at most
        books[row["part"], row["entry"]] = [int(row[f"s{c}"]) // row["n"] for c in range(width)]
    return books


def coded(vectors: DataFrame, vector: str, dims: int, books: np.ndarray) -> DataFrame:
    """Add ``code``, two hex digits per part, and ``error``, the squared distance to what the code says."""
    parts, _, width = books.shape
    names = fresh(vectors, "code"), fresh(vectors, "error")
    kept = [c for c in vectors.columns if c != vector]
    schema = vectors.select(*kept).schema.add(names[0], "string").add(names[1], "long")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches, dims, vector):
            codes = np.zeros((len(x), parts), dtype=np.uint8)
            error = np.zeros(len(x), dtype=object)
            for p in range(parts if len(x) else 0):
                part = x[:, p * width : (p + 1) * width]
                codes[:, p] = label = assigned(part, books[p])[0]
                kind = np.int64 if _safe(part, books[p]) else object
                error += ((part.astype(kind) - books[p][label].astype(kind)) ** 2).sum(axis=1)
            text = pa.array([c.tobytes().hex() for c in codes], pa.string())
            sums = pa.array([int(v) if v <= LONGEST else None for v in error], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), text, sums], [*kept, *names])

    return vectors.mapInArrow(encode, schema)


def digest(books: np.ndarray) -> str:
    """The sha256 of all integers of the codebooks, by part, entry and component."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    rows: DataFrame, id_col: str, vector_col: str, label: Column, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, code, error, label_error`` of each vector, and the codebooks.

    ``label_error`` is the error summed over the vectors of equal labels; null labels are
    equal.
    """
    if entries > 256:
        raise ValueError("a code of two hex digits names 256 entries at the most")
    name, none = F.coalesce(label.cast("string"), F.lit("")).alias("label"), label.isNull().alias("unlabelled")
    ints = F.transform(quantised(F.col(vector_col), scale), lambda v: v.cast("long")).alias("vector")
    vectors = cut(rows.select(F.col(id_col).alias("vec_id"), name, none, ints).filter("vector is not null"))
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    dims = max(1, -(-longest // parts)) * parts
    books = fit(vectors, "vec_id", "vector", dims, parts, entries, rounds)
    found = cut(coded(vectors, "vector", dims, books))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.when(F.count_if(F.col("error").isNull()) == 0, F.when(total <= LONGEST, total).cast("long")).alias("label_error")
    by_label = cut(found.groupBy("label", "unlabelled").agg(total))
    out = lookup_join(found, by_label, ["label", "unlabelled"], ["vec_id", "code"])
    return out.select("vec_id", "code", "error", "label_error"), books
