"""Fill-in-the-middle: the learned index, the cuts beside a plain reading, the way back."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.llm import fill_in_middle as fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LETTERS = st.text(alphabet=" \t\n\x0b\x1f\x85 ab<P>S\U0001f600", max_size=300)


def plain_ends(text):
    return [m.end() for m in TOKEN.finditer(text)]


def plain_transform(doc_id, text, rates=(50, 80)):
    """The same by slices of the list of tokens."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rates[0]:
        return len(tokens), "plain", None, None, text
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < rates[1]:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(LETTERS, st.integers(1, 40))
def test_boundaries_in_portions(text, portion):
    found = [int(x) for part in fim.boundaries(text, portion) for x in part]
    assert found == plain_ends(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 3000), st.sampled_from([1, 5, 100, 1000, 40_000]), st.sampled_from([3, 50, 10**5]))
def test_index_is_exact_and_bounded(seed, n, error, longest):
    draw = np.random.default_rng(seed)
    ends = np.cumsum(draw.integers(1, longest, n)) if n else np.zeros(0, dtype=np.int64)
    index = fim.RankIndex(np.array_split(ends, 3), error)
    assert [index[i] for i in range(n + 1)] == [0, *ends.tolist()]
    assert np.abs(index.residuals).max() <= error + 1


def test_index_is_smaller_than_the_offsets():
    words = " ".join("x" * (2 + (7 * i) % 9) for i in range(200_000))
    index = fim.RankIndex(fim.boundaries(words))
    assert index.count == 200_000 and index.residuals.itemsize == 1 and len(index.ranks) < 50


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.integers(-5, 2**62)), st.one_of(st.none(), LETTERS))
def test_as_by_tokens(doc_id, text):
    assert fim.transformed(None if doc_id is None else str(doc_id), text) == plain_transform(doc_id, text)


def test_transform_and_back(spark):
    long = "word and  more\n" * 100_000
    docs = [(i, t) for i, t in enumerate(["a b c", "", None, " \n ", "lead <P> mark", "<", "P>", "<S", "tail  ", " é 中 \U0001f600 x", long] * 12)]
    docs += [(None, "no id here"), (None, "no id here"), (3, "twice"), (3, "twice")]
    table = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "doc_id long, text string, n long, output string, made string")
    made = fim.transform(table, "doc_id", "text")
    rows = made.select("*", fim.restored(made["output"], made["form"]).alias("back")).collect()
    want = sorted(((d, *plain_transform(d, t), t or "") for d, t in docs), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == want
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert fim.transform(table.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("rates, form", [(fim.Rates(0, 50), {"plain"}), (fim.Rates(100, 100), {"spm"}), (fim.Rates(100, 0), {"psm"})])
def test_rates(rates, form):
    assert {fim.transformed(str(i), "one two three", rates)[1] for i in range(50)} == form
