"""Near duplicates by SimHash fingerprints and a grid join on segment bit counts.

Fingerprint: 64 bits, the majority of the XXH64 values of a text's word shingles.

Links: a fingerprint is cut into 32 segments of two bits and mapped to the number of set
bits of each, a point in {0, 1, 2}^32. The Manhattan distance of two points never
exceeds the number of differing bits. Points are written in unary, ``00 01 11`` for a
segment's 0, 1 and 2: then the distance is the number of differing bits of two 64-bit
numbers, and a step of one along an axis sets or clears one bit. Of two points at
distance 3 or less, the lower or the upper 16 axes lie at distance 1 or less: each point
is stored in one grid cell per half and asks there, and in the cells one step above; a
pair one step apart is found from the lower side. What meets is tested for the bound on
all axes and then exactly.

Only different fingerprints are joined: copies count once. A cell with more than
``crowded`` rows is cut into blocks, and each pair of blocks is one task that returns a
spanning forest of the links it finds, never all of them.

Defined results: a null text has no words and fingerprint zero; fingerprint zero links
like any other; repeated rows and ids are kept; a component without any non-null id has a
null one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.components import components
from evalspark.plans.joins import skew_join
from evalspark.plans.storage import cut

SEED = 42
LOW_BITS = 0x5555555555555555  # the lower bit of each segment
MOST_AT_ONCE = 1 << 16


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    words = text.encode().lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    count = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    sums = np.zeros(64, dtype=np.int64)
    for at in range(0, count, MOST_AT_ONCE):
        first = starts[at : min(at + MOST_AT_ONCE, count)].tolist()
        last = ends[at + shingle - 1 :][: len(first)].tolist() if count > 1 or len(words) >= shingle else [len(joined) + 1]
        h = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(first, last)], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * sums > count, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(np.array([fingerprint_of(t, shingle) for t in part], dtype=np.uint64).view(np.int64))

    return made.asNondeterministic()(text)  # so that no filter runs it a second time


def unary_counts(f: str) -> Column:
    """Bit counts of all segments, in unary."""
    x = F.col(f)
    down = F.shiftrightunsigned(x, 1)
    low = F.lit(LOW_BITS)
    return x.bitwiseOR(down).bitwiseAND(low).bitwiseOR(F.shiftleft(x.bitwiseAND(down).bitwiseAND(low), 1))


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _cells(fingerprints: DataFrame) -> DataFrame:
    """``half, cell, f, p, step``: step 0 is the own cell, step 1 one that lies one step above."""
    halves = fingerprints.select("f", unary_counts("f").alias("p")).select(
        "f", "p", F.posexplode(F.array(F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("p", 32))).alias("half", "own")
    )
    steps = halves.withColumn("axis", F.explode(F.sequence(F.lit(-1), F.lit(15))))
    bit = F.expr("shiftleft(1L, 2 * greatest(axis, 0))")
    count = F.expr("shiftright(own, 2 * greatest(axis, 0)) & 3L")
    up = F.when(count == 0, F.col("own").bitwiseOR(bit)).otherwise(F.col("own").bitwiseOR(F.shiftleft(bit, 1)))
    return steps.filter((F.col("axis") < 0) | (count < 3)).select(
        "half", F.when(F.col("axis") < 0, F.col("own")).otherwise(up).alias("cell"), "f", "p", F.when(F.col("axis") < 0, 0).otherwise(1).alias("step")
    )


def links(fingerprints: DataFrame, most: int = 3, crowded: int = 512) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints ``f`` at ``most`` (3 at the most) differing bits.

    All links of cells that are not crowded; of a crowded cell enough of them to hold
    together what belongs together.
    """
    if most > 3:
        raise ValueError("two halves of the axes guarantee distances up to 3")
    rows = _cells(fingerprints)
    full = cut(rows.groupBy("half", "cell").agg(F.count("*").alias("rows")).filter(F.col("rows") > crowded))
    hot = full.count()
    if hot:
        plain = rows.join(full, ["half", "cell"], "left_anti")
        dense = _dense_links(rows.join(full, ["half", "cell"]), most, crowded)
    else:
        plain = rows
    own = plain.filter("step = 0").select("half", "cell", F.col("f").alias("a"), F.col("p").alias("pa"))
    asks = plain.select("half", "cell", F.col("f").alias("b"), F.col("p").alias("pb"), "step")
    met = own.join(asks, ["half", "cell"]).filter((F.col("step") == 1) | (F.col("a") < F.col("b")))
    found = met.filter(_apart("pa", "pb") <= most).filter(_apart("a", "b") <= most)
    found = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return (found.unionByName(dense) if hot else found).distinct()


def _dense_links(rows: DataFrame, most: int, crowded: int) -> DataFrame:
    """Links within crowded cells: pairs of blocks of about ``crowded`` rows, each a task of its own."""
    parts = F.ceil(F.col("rows") / crowded).cast("int")
    dealt = rows.select("half", "cell", "f", parts.alias("parts"), F.pmod(F.xxhash64("f"), parts).cast("int").alias("block"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "half", "cell", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "f"
    )

    def forest(t: pa.Table) -> pa.Table:
        f = np.unique(t.column("f").to_numpy())
        a, b = spanning_links(f.view(np.uint64), most)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return pairs.groupBy("half", "cell", "x", "y").applyInArrow(forest, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def spanning_links(f: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among unsigned fingerprints, breadth first."""
    free = np.ones(len(f), dtype=bool)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for root in range(len(f)):
        if not free[root]:
            continue
        free[root] = False
        edge = [root]
        while edge:
            i = edge.pop()
            new = np.flatnonzero(free & (np.bitwise_count(f ^ f[i]) <= most))
            free[new] = False
            a.append(np.full(len(new), f[i], dtype=np.uint64))
            b.append(f[new])
            edge.extend(new.tolist())
    empty = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, most: int = 3, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row.

    Texts are read once; what is joined are fingerprints and ids.
    """
    marked = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("f")))
    return component_ids(marked, most).select("doc_id", hexadecimal("f").alias("fingerprint"), "component_id")


def fingerprint_groups(fingerprints: DataFrame, most: int = 3) -> DataFrame:
    """``f, component`` of different fingerprints ``f``: component is the smallest one reachable."""
    found = components(links(fingerprints, most))
    return fingerprints.select("f").join(found, F.col("f") == F.col("node"), "left").select("f", F.coalesce("component", "f").alias("component"))


def component_ids(marked: DataFrame, most: int = 3) -> DataFrame:
    """Add ``component_id``, the smallest ``doc_id`` reachable, to rows ``(doc_id, f, ...)``."""
    distinct = cut(marked.groupBy("f").agg(F.min("doc_id").alias("least"), F.count("*").alias("_rows")))
    grouped = cut(fingerprint_groups(distinct, most).join(distinct, "f"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_each = cut(grouped.join(smallest, "component").select("f", "component_id"))
    return skew_join(marked, of_each, ["f"], ["doc_id"], counts=distinct.select("f", "_rows"))


def hexadecimal(f: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(f))), 16, "0")
