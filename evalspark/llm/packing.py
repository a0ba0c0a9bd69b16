"""Vector bin packing of tokenised examples into training sequences.

An example asks for tokens, one segment and loss-bearing tokens (those after its
prompt); a sequence has a limit on each. Every task packs the rows of its partition as
they come: whole sequences are cut off long examples, the rest waits in a pool of
bounded size. A sequence opens with the room of all three limits and takes, again and
again, the waiting example with the largest dot product of its needs and the room left,
both as shares of the limits. When nothing fits whole, an example is cut to fill the
gap. A sequence that a limit other than that on tokens has closed gives back what lies
beyond a power of two, a length that needs no padding; so do the last ones of a task.

There is no shuffle, and a task holds a batch of rows and its pool. Sequence numbers
carry the partition in their upper bits; a task that runs again makes the same ones.

Defined results: a null text is empty and has the end token alone; repeated rows are
packed each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.tokens import tokenizer

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


TRAINING = Limits(segments=8)  # the query's and the pipeline's: attention masks of eight segments a sequence


class Packer:
    """Packs examples as they come; ``add`` and ``close`` return finished sequences.

    A sequence is a list of pieces ``(example, start, length)``, an example
    ``(key, ids, prompt)``.
    """

    def __init__(self, limits: Limits, pool: int = 256):
        self.limits, self.size = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64), pool
        self.limit = limits
        self.waiting: list[list] = []  # [example, start]
        self.needs = np.zeros((0, 3))

    def _need(self, item: list) -> tuple[int, int, int]:
        (_, ids, prompt), start = item
        return len(ids) - start, 1, len(ids) - max(start, prompt)

    def _put(self, example, start: int) -> None:
        item = [example, start]
        self.waiting.append(item)
        self.needs = np.vstack([self.needs, self._need(item)])

    def _take(self, i: int) -> list:
        self.needs = np.delete(self.needs, i, axis=0)
        return self.waiting.pop(i)

    def add(self, example) -> Iterator[list]:
        _, ids, prompt = example
        start, most = 0, self.limit.tokens
        while len(ids) - start >= most and most - max(0, min(prompt - start, most)) <= self.limit.loss:
            yield [(example, start, most)]
            start += most
        if start < len(ids):
            self._put(example, start)
        while len(self.waiting) >= self.size:
            yield self._sequence()

    def close(self) -> Iterator[list]:
        while self.waiting:
            yield self._sequence()

    def _sequence(self) -> list:
        room, pieces = self.limits.copy(), []
        while self.waiting:
            fits = (self.needs <= room).all(axis=1)
            if fits.any():
                value = (self.needs / self.limits) @ (room / self.limits)
                i = int(np.argmax(np.where(fits, value, -1.0)))  # of equals, the one that has waited longest
                example, start = self._take(i)
                length = len(example[1]) - start
            elif (room > 0).all():  # nothing fits whole: cut the largest
                i = int(np.argmax(self.needs[:, 0]))
                (example, start) = self.waiting[i]
                silent = max(0, example[2] - start)
                length = int(min(room[0], silent + room[2], len(example[1]) - start))
                self._take(i)
                if start + length < len(example[1]):
                    self._put(example, start + length)
            else:
                break
            pieces.append((example, start, length))
            room -= (length, 1, max(0, start + length - max(start, example[2])))
        return self._trimmed(pieces)

    def _trimmed(self, pieces: list) -> list:
        """Give back what lies beyond the largest power of two, if tokens are left over."""
        total = sum(p[2] for p in pieces)
        if total == self.limit.tokens:
            return pieces
        over = total - (1 << (total.bit_length() - 1))
        while over:
            example, start, length = pieces.pop()
            cut = min(over, length)
            if cut < length:
                pieces.append((example, start, length - cut))
            self._return(example, start + length - cut, start + length)
            over -= cut
        return pieces

    def _return(self, example, start: int, end: int) -> None:
        """Put back ``ids[start:end]``; what follows ``end`` waits or is placed already."""
        for i, (other, s) in enumerate(self.waiting):
            if other is example and s == end:  # joins the rest of its own example
                self._take(i)
                return self._put(example, start)
        key, ids, prompt = example
        self._put(_Cut(key, ids, prompt, end), start)


class _Cut(tuple):
    """An example that ends before its ids do; behaves as ``(key, ids[:end], prompt)``."""

    def __new__(cls, key, ids, prompt, end):
        return super().__new__(cls, (key, ids[:end], prompt))


def heading(text: Column) -> Column:
    """The first line of a text of several lines, line break included; empty for a text of one line."""
    return F.regexp_extract(text, r"\A[^\n]*\n", 0)


def pack(
    docs: DataFrame, id_col: str, text_col: str, limits: Limits = Limits(), end_id: int | None = 1, prompt: Column | None = None,
    prompt_text: Column | None = None, vocabulary: str | None = None, pool: int = 256,
) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    ``prompt`` gives the number of leading tokens of a row that bear no loss; where
    ``prompt_text`` is given instead, those are the tokens that end within so many bytes as
    it has. ``end_id`` is the token put after each document. ``ids_crc32`` is that of the
    piece's ids as little-endian 32-bit numbers. A null prompt is empty.
    """
    in_bytes = prompt_text is not None
    silent = F.octet_length(prompt_text) if in_bytes else F.lit(0) if prompt is None else prompt
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(silent, F.lit(0)).cast("long").alias("prompt"),
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, within = tokenizer(vocabulary).encode_array, tokenizer(vocabulary).within
        packer, number = Packer(limits, pool), TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def keep(sequences):
            nonlocal number
            for pieces in sequences:
                at = 0
                for ((doc_id, total), ids, silent), start, length in pieces:
                    crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
                    out.append((doc_id, start, length, crc, total, number, at, max(0, start + length - max(start, silent))))
                    at += length
                number += 1

        def batch() -> pa.RecordBatch:
            names = [c.split()[0] for c in OUT.split(", ")]
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
            out.clear()
            return made

        for rows in batches:
            for doc_id, text, silent in zip(*(rows.column(i) for i in range(3))):
                ids, silent = encode(text.as_py()), silent.as_py()
                if in_bytes:
                    silent = within(ids, silent)
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                if len(ids):
                    keep(packer.add(((doc_id.as_py(), len(ids)), ids, min(max(0, silent), len(ids)))))
                if len(out) >= 20_000:
                    yield batch()
        keep(packer.close())
        if out:
            yield batch()

    return rows.mapInArrow(packed, OUT)
