"""Best-fit packing: whole pieces, gapless places, steps that raise the squared fill, few sequences."""

import collections
import itertools
import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.llm import best_fit as bf
from evalspark.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def fills(bins, lengths):
    return [sum(lengths[i] for i in b) for b in bins]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_bins_hold_each_once(lengths):
    bins = bf.packed_bins(lengths, 40)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    filled = fills(bins, lengths)
    assert all(0 < f <= 40 for f in filled) and filled == sorted(filled, reverse=True)
    first = bf.best_fit(lengths, 40)
    assert len(bins) <= len(first) and sum(f * f for f in filled) >= sum(f * f for f in fills(first, lengths))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60))
def test_best_fit_as_by_looking_at_all(lengths):
    bins, rooms = [], []
    for size in sorted(lengths, reverse=True):
        able = [b for b in range(len(bins)) if rooms[b] >= size]
        if able:
            b = min(able, key=lambda b: rooms[b])
        else:
            b = len(bins)
            bins.append([])
            rooms.append(12)
        bins[b].append(size)
        rooms[b] -= size
    assert sorted(fills(bf.best_fit(lengths, 12), lengths)) == sorted(12 - r for r in rooms)


def steps_left(bins, lengths, most):
    """Whether any move or exchange of one or two for one between bins with room raises the squared fill."""
    sizes = [[lengths[i] for i in b] for b in bins]
    low = [b for b in sizes if sum(b) < most]
    for a, b in itertools.permutations(range(len(low)), 2):
        for n, m in ((0, 1), (1, 1), (2, 1), (1, 2)):
            for give, take in itertools.product(itertools.combinations(low[a], n), itertools.combinations(low[b], m)):
                gain = sum(take) - sum(give)
                if gain > 0 and sum(low[a]) + gain <= most and sum(low[a]) + gain > sum(low[b]):
                    return True
    return False


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(3, 25))
def test_search_ends_where_no_step_is_left(seed, n):
    draw = random.Random(seed)
    lengths = [draw.randint(8, 30) for _ in range(n)]
    bins = bf.packed_bins(lengths, 50)
    assert len(bins) == -(-sum(lengths) // 50) or not steps_left(bins, lengths, 50)


def test_search_saves_sequences():
    lengths = np.random.default_rng(1).integers(200, 500, 8192).tolist()
    first, found = bf.best_fit(lengths, 1024), bf.packed_bins(lengths, 1024)
    assert len(found) < 0.98 * len(first)


def checked(rows, ids_of, most):
    """Rows as pieces of documents and as gapless sequences; returns the number of sequences."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids_of)
    for doc_id, found in by_doc.items():
        ids, at = ids_of[doc_id], 0
        for i, r in enumerate(sorted(found, key=lambda r: r["piece"])):
            want = most if i else (len(ids) - 1) % most + 1
            assert (r["piece"], r["start"], r["length"]) == (i, at, want)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + want], dtype="<u4").tobytes())
            at += want
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= most
    return len(by_sequence)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    ids = {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in docs.items()}
    rows = QUERIES["op13_best_fit"](spark, SF).collect()
    used, least = checked(rows, ids, 1024), -(-sum(map(len, ids.values())) // 1024)
    assert least <= used <= 1.02 * least + 1


def test_levels_and_edges(spark, library):
    """Many groups, packed together again; nulls, empty and long texts, repeated rows, clashing names."""
    draw = random.Random(4)
    texts = [" ".join("word" for _ in range(draw.randint(0, 40))) for _ in range(1500)] + ["long " * 3000, None, "", "<|endoftext|>"]
    docs = [(i, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, row long, length long, again string").repartition(5)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in docs}
    for most, group in ((32, 128), (1024, 8192)):
        used = checked(bf.pack(table, "doc_id", "text", most, group=group).collect(), ids, most)
        assert used <= -(-sum(map(len, ids.values())) // most) + (2 if most > 32 else 30)
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None)], "doc_id long, text string")
    rows = bf.pack(twice, "doc_id", "text").collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None", "None"] and len({r["sequence_id"] for r in rows}) == 1
    ends = sorted((r["offset"], r["offset"] + r["length"]) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert bf.pack(table.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        bf.pack(table, "doc_id", "text", 1024, group=1024)
