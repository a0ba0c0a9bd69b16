"""Vector codes: dual-tree assignment beside every distance, whole fits beside a plain one."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.llm import vector_codes as vc


def plain_assign(x, entries):
    apart = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return apart.argmin(axis=1)  # the first of equals


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 400), st.integers(1, 70), st.integers(1, 5), st.sampled_from([1, 3, 50, 10**6]))
def test_dual_trees_as_every_distance(seed, n, k, d, spread):
    draw = np.random.default_rng(seed)
    x, entries = draw.integers(-spread, spread + 1, (n, d)), draw.integers(-spread, spread + 1, (k, d))
    label, weights, sums = vc.assigned(x, entries)
    want = plain_assign(x, entries)
    assert (label == want).all()
    assert (weights == np.bincount(want, minlength=k)).all()
    for e in range(k):
        assert (sums[e] == x[want == e].sum(axis=0)).all()
    large = vc._nearest_large(x, np.ones(n, dtype=np.int64), entries)
    assert (large[0] == want).all() and (large[2].astype(np.int64) == sums).all()


def test_bounds_save_distances():
    draw = np.random.default_rng(3)
    centres = draw.integers(-2000, 2000, (64, 4))
    x = centres[draw.integers(0, 64, 8000)] + draw.integers(-40, 41, (8000, 4))
    seen = {}
    label, _, _ = vc.nearest(x, np.ones(8000, dtype=np.int64), centres, seen)
    assert (label == plain_assign(x, centres)).all()
    assert seen["whole"] > 6000 and seen["whole"] + seen["alone"] == 8000
    assert seen["pairs"] < 8000 * 64 / 20


def plain_compress(rows, parts, entries, rounds, scale=256):
    """``code, error`` by position and the digest, in Python integers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    dims = -(-max(1, max(len(v) for _, v in kept)) // parts) * parts
    width = dims // parts

    def whole_of(v):
        return [max(-(2**63), min(2**63 - 1, math.floor(scale * float(c)))) for c in v]

    x = np.array([c for _, v in kept for c in whole_of([*v, *[0.0] * (dims - len(v))])], dtype=object).reshape(len(kept), parts, width)
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole_of(kept[i][1])))[:entries]
    books = np.array([[x[i][p] for i in first] for p in range(parts)], dtype=object)

    def labels():
        apart = [[[int(((x[i][p] - b) ** 2).sum()) for b in books[p]] for p in range(parts)] for i in range(len(kept))]
        return [[min(range(len(a)), key=a.__getitem__) for a in row] for row in apart], [sum(min(a) for a in row) for row in apart]

    for _ in range(rounds):
        own, _ = labels()
        for p in range(parts):
            for e in range(len(first)):
                mine = [x[i][p] for i in range(len(kept)) if own[i][p] == e]
                if mine:
                    books[p][e] = [sum(int(m[c]) for m in mine) // len(mine) for c in range(width)]
    own, error = labels()
    codes = ["".join(f"{e:02x}" for e in row) for row in own]
    return [(kept[i][0], codes[i], error[i]) for i in range(len(kept))], hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


@pytest.mark.parametrize("n, dims, parts, entries, spread", [(300, 12, 3, 20, 2.0), (40, 7, 2, 64, 0.01), (5, 3, 4, 64, 1.0), (60, 4, 2, 8, 1e30)])
def test_whole_fit(spark, n, dims, parts, entries, spread):
    draw = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(c)) for c in draw.normal(0, spread, dims)]) for i in draw.permutation(n)]
    rows += [(rows[0][0], rows[0][1]), (None, rows[1][1]), (7, rows[2][1][:1]), (8, []), (9, None), (10, [None, 1.0]), (11, [math.nan]), (12, [math.inf])]
    rows += [(1000 + i, rows[3][1]) for i in range(50)]  # a hot vector
    table = [(i, v, None if j % 5 == 0 else j % 3, 1, "x") for j, (i, v) in enumerate(rows)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, error int, vector string").repartition(3)
    out, books = vc.compress(df, "vec_id", "embedding", F.col("label"), parts, entries, 2)
    got = out.collect()
    want, sha = plain_compress(rows, parts, entries, 2)
    assert vc.digest(books) == sha
    most = 2**63 - 1
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=str) == sorted(((i, c, e if e <= most else None) for i, c, e in want), key=str)
    kept = [t for t in table if t[1] is not None and all(c is not None and math.isfinite(c) for c in t[1])]
    by_label = {}
    for t, (_, _, e) in zip(kept, want):
        by_label.setdefault(t[2], []).append(e)
    sums = {k: sum(v) if max(v) <= most and sum(v) <= most else None for k, v in by_label.items()}
    assert sorted((str(r["label_error"]) for r in got)) == sorted(str(sums[t[2]]) for t in kept)


def test_empty(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    out, books = vc.compress(df, "vec_id", "embedding", F.col("label"))
    assert out.count() == 0 and books.size == 0
