"""Best-fit packing of tokenised documents, improved by swaps between sequences.

A document that is longer than a sequence is cut from its end into pieces that fill one
each; what is left before them is its first piece. Pieces that don't fill a sequence are
dealt by a hash of their row into groups of about ``group`` rows. A task packs a group:

1. best fit, longest first: a piece goes to the fullest sequence that has room;
2. local search: a sequence that isn't full takes tokens from an emptier one, by moving a
   piece over, or by exchanging one piece for one, one for two or two for one. Only steps
   that raise the sum of squared fills are taken, of those for a sequence the one that
   takes most. Sequences become full or empty, and an empty one is gone. The search ends
   when it has looked at all sequences and found no step, or when the lower bound is met.

So a group leaves little room but in its emptiest sequence. The pieces of those
are packed together again, in groups of the same size, until there is one group. No task
has more rows than a group; only numbers are shuffled, never texts.

Defined results: a null text is empty and has the end token alone; repeated rows and ids
are packed each for itself; a null id is kept; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.tokens import tokenizer
from evalspark.plans.storage import cut

SEQUENCE = 1024
GROUP = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def best_fit(lengths: Iterable[int], most: int) -> list[list[int]]:
    """Positions of the lengths in each bin, longest first into the fullest bin with room."""
    lengths = list(lengths)
    with_room: list[list[int]] = [[] for _ in range(most + 1)]
    rooms = 0  # bit r: some bin has room r
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(bins), most
            bins.append([])
        bins[b].append(i)
        if room > size:
            with_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


class Search:
    """Bins that aren't full, and which of them hold a length or two lengths of a sum.

    A place in the index is a heap of bins, emptiest first. Entries are as of the time
    they were made: one counts if its bin hasn't changed since.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], most: int):
        self.most, self.lengths = most, lengths
        self.bins = [sorted(b, key=lambda i: lengths[i]) for b in bins]
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.version = [0] * len(bins)
        self.one: list[list[tuple]] = [[] for _ in range(most + 1)]
        self.two: list[list[tuple]] = [[] for _ in range(most + 1)]
        self.ones = self.twos = 0  # bit s: there is an entry at s
        for b in range(len(bins)):
            self._note(b)

    def _note(self, b: int) -> None:
        """Enter the lengths of a bin and their sums in the index."""
        if self.fill[b] in (0, self.most):
            return
        have = [self.lengths[i] for i in self.bins[b]]
        entry = (self.fill[b], b, self.version[b])
        for s in set(have):
            heapq.heappush(self.one[s], entry)
            self.ones |= 1 << s
        for s in _pair_sums(have):
            heapq.heappush(self.two[s], entry)
            self.twos |= 1 << s

    def _emptiest(self, heaps: list[list[tuple]], s: int, but: int) -> int | None:
        """The emptiest bin, other than ``but``, noted at ``s``; entries of the past are dropped."""
        heap, aside, found = heaps[s], None, None
        while heap:
            _, b, version = heap[0]
            if version != self.version[b]:
                heapq.heappop(heap)
            elif b == but:
                aside = heapq.heappop(heap)
            else:
                found = b
                break
        if aside:
            heapq.heappush(heap, aside)
        if not heap:
            if heaps is self.one:
                self.ones &= ~(1 << s)
            else:
                self.twos &= ~(1 << s)
        return found

    def _best(self, b: int) -> tuple | None:
        """``(gain, given, taken, donor)``: the step that takes most into ``b``; of equals the first."""
        room, fill = self.most - self.fill[b], self.fill[b]
        have = [self.lengths[i] for i in self.bins[b]]
        gives = [((), 0)] + [((s,), s) for s in sorted(set(have))]
        pairs = [((x, s - x), s) for s, x in sorted(_pair_sums(have).items())]
        best = None
        for given, worth in gives + pairs:
            for heaps, count in ((self.one, 1), (self.two, 2)):
                if len(given) + count > 3 or (not given and count == 2):
                    continue
                # Takes that gain 1 to ``room`` tokens, the largest gain first.
                window = (self.ones if count == 1 else self.twos) >> (worth + 1) & ((1 << room) - 1)
                while window:
                    gain = window.bit_length()
                    if best is not None and gain <= best[0]:
                        break
                    window ^= 1 << (gain - 1)
                    donor = self._emptiest(heaps, worth + gain, b)
                    if donor is not None and fill + gain > self.fill[donor]:
                        best = (gain, given, (count, worth + gain), donor)
                        break
            if best is not None and best[0] == room:
                break
        return best

    def _step(self, b: int, step: tuple) -> None:
        gain, given, (count, worth), donor = step
        if count == 1:
            taken = (worth,)
        else:
            x = _pair_sums([self.lengths[i] for i in self.bins[donor]])[worth]
            taken = (x, worth - x)
        over, back = self._out(donor, taken), self._out(b, given)
        for to, items, change in ((b, over, gain), (donor, back, -gain)):
            self.bins[to] = sorted(self.bins[to] + items, key=lambda i: self.lengths[i])
            self.fill[to] += change
            self.version[to] += 1
            self._note(to)

    def _out(self, b: int, sizes: tuple) -> list[int]:
        out = []
        for s in sizes:
            i = next(i for i in self.bins[b] if self.lengths[i] == s)
            self.bins[b].remove(i)
            out.append(i)
        return out

    def run(self) -> list[list[int]]:
        least, used = -(-sum(self.fill) // self.most), sum(f > 0 for f in self.fill)
        changed = True
        while changed and used > least:
            changed = False
            for b in sorted(range(len(self.bins)), key=lambda b: (-self.fill[b], b)):
                while 0 < self.fill[b] < self.most:
                    step = self._best(b)
                    if step is None:
                        break
                    self._step(b, step)
                    changed = True
                    used -= self.fill[step[3]] == 0
                if used == least:
                    break
        return [b for b in self.bins if b]


def _pair_sums(have: list[int]) -> dict[int, int]:
    """Sums of two of the lengths, each with one of a pair that makes it."""
    kinds = sorted(set(have))
    twice = {s for s in kinds if have.count(s) > 1} if len(kinds) < len(have) else ()
    return {x + y: x for i, x in enumerate(kinds) for y in kinds[i if x in twice else i + 1 :]}


def packed_bins(lengths: Iterable[int], most: int = SEQUENCE) -> list[list[int]]:
    """Positions of the lengths in each bin, by best fit and local search; the emptiest bin comes last."""
    lengths = [int(n) for n in lengths]
    bins = Search(best_fit(lengths, most), lengths, most).run()
    return sorted(bins, key=lambda b: -sum(lengths[i] for i in b))


def pieces(docs: DataFrame, id_col: str, text_col: str, most: int, end_id: int | None, vocabulary: str | None) -> DataFrame:
    """One row per piece of ``most`` tokens or fewer, and a number ``row`` of its own."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = tokenizer(vocabulary).encode_array, TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for rows in batches:
            for doc_id, text in zip(rows.column(0), rows.column(1)):
                ids = encode(text.as_py()).astype("<u4", copy=False)
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                edges = [0, *range((len(ids) - 1) % most + 1, len(ids) + 1, most)] if len(ids) else []
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    out.append((doc_id.as_py(), i, a, b - a, zlib.crc32(ids[a:b].tobytes()), number))
                    number += 1
                if len(out) >= 20_000:
                    yield batch()
        if out:
            yield batch()

    return rows.mapInArrow(made, PIECES)


def pack(
    docs: DataFrame, id_col: str, text_col: str, most: int = SEQUENCE, end_id: int | None = 2, vocabulary: str | None = None, group: int = GROUP
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece.

    ``end_id`` is the token put after each document. ``ids_crc32`` is that of the piece's
    ids as little-endian 32-bit numbers.
    """
    if group < 4 * most:
        raise ValueError("a group has to make several sequences, or the levels would not end")
    found = cut(pieces(docs, id_col, text_col, most, end_id, vocabulary))
    # A full piece is a sequence by itself, numbered below zero; packed ones count from zero.
    full = found.filter(F.col("length") == most).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_rows, placed, base, level = found.filter(F.col("length") < most).select("row", "length"), [full], 0, 0
    waiting = open_rows.count()
    while waiting:
        groups = -(-waiting // group)
        done = cut(_packed(open_rows, groups, most, base, level, last=groups == 1))
        placed.append(done.filter("not again").select("row", "sequence_id", "offset"))
        open_rows = done.filter("again").select("row", "length")
        base, level, waiting = base + groups, level + 1, 0 if groups == 1 else open_rows.count()
    places = placed[0]
    for p in placed[1:]:
        places = places.unionByName(p)
    return found.join(places, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _packed(rows: DataFrame, groups: int, most: int, base: int, level: int, last: bool) -> DataFrame:
    """Sequence and place of each row; ``again`` marks the rows of each group's emptiest sequence."""
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)))

    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("row", "ascending")])  # the same on every run
        row, length = t.column("row").to_numpy(), t.column("length").to_numpy()
        bins = packed_bins(length, most)
        order = np.array([i for b in bins for i in b], dtype=np.int64)
        sizes = np.array([len(b) for b in bins])
        which = np.repeat(np.arange(len(bins)), sizes)
        ends = np.cumsum(length[order])
        starts = ends - length[order]
        firsts = np.repeat(starts[np.cumsum(sizes) - sizes], sizes)
        number = (base + t.column("group")[0].as_py() << 32) + which
        again = (which == len(bins) - 1) & (not last) & (ends[-1] - firsts[-1] < most)
        return pa.table({"row": row[order], "length": length[order], "sequence_id": number, "offset": starts - firsts, "again": again})

    return dealt.groupBy("group").applyInArrow(packed, "row long, length long, sequence_id long, offset long, again boolean")
