"""Fill-in-the-middle texts, cut through a learned index of token boundaries.

A text is cut into tokens, each a run of other characters with the white space before it
(white space at the end is a token of its own). A prefix, a middle and a suffix of whole
tokens are drawn from a hash of the row's id and put in another order between marks.

Where a cut lies is asked of an index from rank to offset. Piecewise linear segments are
fitted to the offsets of all boundaries: a segment starts at a boundary and goes on while
some slope keeps every boundary within ``ERROR`` characters (the cone of such slopes
shrinks from boundary to boundary). What a segment predicts and what is true differ by a
residual, stored in one or two bytes per boundary; an offset is the prediction plus the
residual, so it is exact. Segments end where the portion of the text ends that is read at
a time, so beside the text an index needs about one byte per token.

There is no shuffle; a task holds one batch of rows.

Defined results: a null text is empty; an empty one has no tokens and is plain; a null id
is hashed as an empty text; repeated rows are each transformed, alike; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = 100  # characters by which a segment may miss a boundary
PORTION = 1 << 20  # characters read at a time
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def boundaries(text: str, portion: int = PORTION) -> Iterator[np.ndarray]:
    """Offsets of the ends of all tokens, in order, a portion of the text at a time."""
    inside = False  # whether the portion before ended in a token's characters
    for at in range(0, len(text), portion):
        part = text[at : at + portion]
        c = np.frombuffer(part.encode("utf-32-le"), dtype="<u4")
        space = (c == 0x20) | ((c >= 0x09) & (c <= 0x0D))
        ends = at + np.flatnonzero(space & ~np.concatenate([[not inside], space[:-1]]))
        inside = not space[-1]
        if at + portion >= len(text):  # the last token ends with the text, be it white space or not
            ends = np.append(ends, len(text))
        yield ends


class RankIndex:
    """From the rank of a boundary (0 is the start of the text) to its offset, exactly."""

    def __init__(self, portions: Iterator[np.ndarray], error: int = ERROR):
        self.error, self.count = error, 0
        ranks, offsets, slopes, residuals = [0], [0], [0.0], [np.zeros(1, dtype=np.int8)]
        for ends in portions:
            at = 0
            while at < len(ends):
                length, slope = self._segment(ends, at)
                line = ends[at] + np.floor(np.arange(length) * slope).astype(np.int64)
                ranks.append(self.count + 1)
                offsets.append(int(ends[at]))
                slopes.append(slope)
                residuals.append((ends[at : at + length] - line).astype(np.int8 if error < 127 else np.int16 if error < 32767 else np.int64))
                self.count += length
                at += length
        self.ranks, self.offsets, self.slopes = np.array(ranks), np.array(offsets), np.array(slopes)
        self.residuals = np.concatenate(residuals)

    def _segment(self, ends: np.ndarray, at: int, first: int = 64) -> tuple[int, float]:
        """Length and slope of the longest segment from ``at`` on, looked for in doubling steps."""
        low, high, done, step = 0.0, np.inf, 1, first
        while at + done < len(ends):
            run = np.arange(done, min(done + step, len(ends) - at))
            rise = ends[at + run] - ends[at]
            lows = np.maximum.accumulate(np.maximum((rise - self.error) / run, low))
            highs = np.minimum.accumulate(np.minimum((rise + self.error) / run, high))
            closed = np.flatnonzero(lows > highs)
            fitting = int(closed[0]) if len(closed) else len(run)
            if fitting:
                low, high, done = float(lows[fitting - 1]), float(highs[fitting - 1]), done + fitting
            if fitting < len(run):
                break
            step *= 2
        return done, low if high == np.inf else (low + high) / 2

    def __getitem__(self, rank: int) -> int:
        i = int(np.searchsorted(self.ranks, rank, side="right")) - 1
        predicted = int(self.offsets[i]) + int(np.floor((rank - self.ranks[i]) * self.slopes[i]))
        return predicted + int(self.residuals[rank])


@dataclass(frozen=True)
class Rates:
    """Per cent of texts that are transformed, and of these the ones with the suffix first."""

    transformed: int = 50
    suffix_first: int = 80


def draws(doc_id: str | None, seed: int) -> list[int]:
    """Four numbers of 32 bits of a row: two cuts, whether it is transformed, which order."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transformed(doc_id: str | None, text: str | None, rates: Rates = Rates(), seed: int = 42) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one row."""
    text = text or ""
    index = RankIndex(boundaries(text))
    n = index.count
    first, second, whether, order = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or whether % 100 >= rates.transformed:
        return n, "plain", None, None, text
    a, b = (index[r] for r in sorted((first % (n + 1), second % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < rates.suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(doc_id: Column, text: Column, rates: Rates = Rates(), seed: int = 42) -> Column:
    """The struct ``n, form, prefix_chars, middle_chars, output`` of each row.

    ``form`` is ``plain`` (the text itself), ``psm`` or ``spm`` (the order of prefix,
    suffix and middle); the numbers of characters are null where it is plain.
    """
    names = [c.split()[0] for c in OUT.split(", ")]

    @F.pandas_udf(OUT)
    def made(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in parts:
            rows = [transformed(i, t, rates, seed) for i, t in zip(ids, texts)]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return made.asNondeterministic()(doc_id.cast("string"), text)  # so that no filter runs it a second time


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. No text between marks holds a mark, so they split it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, third = (F.get(parts, i) for i in (1, 2, 3))
    suffix_first, prefix_first = F.concat(second, third, first), F.concat(first, third, second)
    return F.when(form == "spm", suffix_first).when(form == "psm", prefix_first).otherwise(output)


def transform(docs: DataFrame, id_col: str, text_col: str, rates: Rates = Rates(), seed: int = 42) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each row."""
    made = fill_in_middle(F.col(id_col), F.col(text_col), rates, seed)
    return docs.select(F.col(id_col).alias("doc_id"), made.alias("made")).select("doc_id", "made.*")
