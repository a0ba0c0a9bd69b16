"""Byte-pair encoding as a transducer with bounded lookahead, and its inverse.

How far ahead a merge can depend on the text follows from the merge list. A merge of u
and v happens unless v never forms whole, which takes a merge of lower rank between a
suffix of v and what follows, and so on with falling ranks: the longest such chain, in
bytes, is the sufficient lookahead of u. That of a token is the largest of itself and of
the suffixes it was merged from (``ahead``), that of the list the largest of all
(``lookahead``).

Texts go through a ``Transducer`` in chunks of characters. It holds back what the pattern
of the vocabulary or a special string could still change: a few characters, since a piece
is closed once the two characters after it are known. Closed pieces give their tokens at
once, and those of short pieces are remembered (up to a bound, and from one task of a
Python worker to its next). A long piece that is still open gives each token whose lookahead lies before the end of the bytes seen, and
merging goes on from there, since no merge crosses the border of final tokens. So memory
is bounded by a chunk and the lookahead, however long the input.

The decoder is a state machine over bytes: tokens go in one by one, characters come out
when complete, malformed bytes as U+FFFD.

Defined results: a null text is empty, with no token; repeated rows get equal answers; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.tokens import byte_letters, vocabulary_path

OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
REMEMBERED = 250_000
NEVER = 1 << 40  # the rank of a pair that doesn't merge
CHUNK = 16_384  # characters that go into the transducer at a time
SHORT = 64  # characters of an open piece that are held back whole, and of a closed one that is remembered

# The pattern of byte-level vocabularies; \s as Unicode has it, without the separators U+001C to U+001F.
_SPACE = r"[\t-\r \x85\xa0  -     　]"
_BLANK = r"\t-\r \x85\xa0  -     　"
_PIECE = rf" ?[%s]+| ?[%s]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_BLANK}%s]+|{_SPACE}+(?![^{_BLANK}])|{_SPACE}+"
PATTERN = regex.compile(_PIECE % (r"\p{L}", r"\p{N}", r"\p{L}\p{N}"))
_LETTERS, _DIGITS = ("".join(regex.findall(kind, "".join(map(chr, range(256))))) for kind in (r"\p{L}", r"\p{N}"))
NARROW = re.compile(_PIECE % (_LETTERS, _DIGITS, _LETTERS + _DIGITS))  # the same for texts up to U+00FF, in half the time
LETTERS, DIGITS, SIGNS, SPACES = map(regex.compile, (r"\p{L}*", r"\p{N}*", rf"[^{_BLANK}\p{{L}}\p{{N}}]*", rf"{_SPACE}*"))


class Vocabulary:
    """Merges and tokens of a byte-level vocabulary in the JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in stated["model"]["vocab"].items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        ids = {b: i for i, b in self.bytes.items()}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        vocab = stated["model"]["vocab"]
        for rank, pair in enumerate(stated["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        right: dict[int, dict[int, int]] = {}
        for (a, b), (rank, _) in self.merges.items():
            right.setdefault(a, {})[b] = rank
        self.rank = [right.get(i, {}).get for i in range(max(self.bytes) + 1)]  # by left token, asked with the right one
        self.byte_ranks = [self.rank[a](b, NEVER) for a in self.byte_ids for b in self.byte_ids]
        self.made = [made for _, made in self.merges.values()]
        self.ahead = self._ahead()
        self.lookahead = max(self.ahead.values())
        self.longest_special = max(map(len, self.special), default=0)
        starts = "".join(regex.escape(x) for x in sorted({x[0] for x in self.special}))
        self.special_start = regex.compile(f"[{starts}]") if self.special else None

    def _ahead(self) -> dict[int, int]:
        """By token: bytes after its end that must be known before it is final."""
        reach: dict[int, int] = {}  # by left token: bytes that a merge of a rank seen so far depends on, from its end on
        ends: dict[int, int] = {}  # by token: its right half
        for (u, v), (_, made) in sorted(self.merges.items(), key=lambda m: m[1][0]):
            here = len(self.bytes[v]) + max(reach.get(s, 0) for s in _suffixes(v, ends))
            reach[u] = max(reach.get(u, 0), here)
            ends.setdefault(made, v)
        return {t: max(1, *(reach.get(s, 0) for s in _suffixes(t, ends))) for t in self.bytes}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a short byte string: the lowest rank first, of equals the leftmost."""
        byte_ids, byte_ranks, rank, made = self.byte_ids, self.byte_ranks, self.rank, self.made
        ids = [byte_ids[b] for b in piece]
        ranks = [byte_ranks[a << 8 | b] for a, b in zip(piece, piece[1:])]
        while ranks and (least := min(ranks)) < NEVER:
            at = ranks.index(least)
            ids[at] = new = made[least]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank[new](ids[at + 1], NEVER)
            if at:
                ranks[at - 1] = rank[ids[at - 1]](new, NEVER)
        return ids

    def merged_long(self, piece: bytes) -> list[int]:
        """The same with a queue of pairs, in time n log n."""
        ids: list = [self.byte_ids[b] for b in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        merges, n = self.merges, len(ids)
        queue = [(merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            made = merges[a, b][1]
            ids[i], ids[j] = made, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (p := (made, ids[after[j]])) in merges:
                    heapq.heappush(queue, (merges[p][0], i, *p))
            if (h := before[i]) >= 0 and (p := (ids[h], made)) in merges:
                heapq.heappush(queue, (merges[p][0], h, *p))
        return [x for x in ids if x is not None]


def pattern(text: str) -> re.Pattern | regex.Pattern:
    """The pattern that cuts ``text`` soonest."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return PATTERN
    return NARROW


def _suffixes(token: int, ends: dict[int, int]) -> Iterator[int]:
    """The token and all its suffixes along the tree of its merges."""
    s: int | None = token
    while s is not None:
        yield s
        s = ends.get(s)


class Known(dict):
    """By closed piece its ids: merged when it is met, and remembered if short."""

    def __init__(self, vocabulary: Vocabulary, remembered: int):
        self.vocabulary, self.remembered = vocabulary, remembered
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> Sequence[int]:
        if len(piece) > SHORT:
            return self.vocabulary.merged_long(piece.encode())
        ids = self.older.get(piece) or tuple(self.vocabulary.merged(piece.encode()))
        if len(self) >= self.remembered:  # pieces not met since the last time are forgotten
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Encodes texts; ``pieces`` yields ids as they become final."""

    def __init__(self, vocabulary: Vocabulary, chunk: int = CHUNK, remembered: int = REMEMBERED):
        self.vocabulary, self.chunk = vocabulary, chunk
        self.known = Known(vocabulary, remembered)

    def pieces(self, text: str) -> Iterator[list[int]]:
        state = Transducer(self)
        for i in range(0, len(text), self.chunk):
            yield state.feed(text[i : i + self.chunk])
        yield state.end()

    def closed(self, words: list[str], out: list[int]) -> None:
        """Appends the ids of pieces that nothing can change any more."""
        out.extend(chain.from_iterable(map(self.known.__getitem__, words)))


class Transducer:
    """Characters go in by ``feed``, ids come out once nothing that follows can change them."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.vocabulary = encoder, encoder.vocabulary
        self.text = ""  # characters whose pieces aren't certain yet
        self.kind = None  # how an open long piece goes on
        self.open = b""  # its bytes whose tokens aren't final yet
        self.due = 0  # bytes at which merging them again may pay

    def feed(self, chars: str) -> list[int]:
        return self._advance(self.text + chars, False)

    def end(self) -> list[int]:
        return self._advance(self.text, True)

    def _advance(self, text: str, final: bool) -> list[int]:
        out: list[int] = []
        at, seen, v = 0, len(text), self.vocabulary
        if v.special_start is not None and v.special_start.search(text):
            if not final:  # what may be the start of a special string waits
                begun = v.special_start.search(text, max(0, len(text) - v.longest_special + 1))
                seen = begun.start() if begun else seen
            for m in v.special_pattern.finditer(text):
                if m.start() >= seen:
                    break
                self._plain(text, at, m.start(), True, out)
                out.append(v.special[m[0]])
                at = m.end()
        at = self._plain(text, at, max(at, seen), final, out)
        self.text = text[at:]
        return out

    def _plain(self, text: str, start: int, end: int, final: bool, out: list[int]) -> int:
        """Takes in ``text[start:end]``, which holds no special string, as far as it is certain; returns how far."""
        if self.kind is not None:
            stop = self.kind.match(text, start, end).end()
            over = stop < end or final
            if self.kind is SPACES and not (final and stop == end):
                stop = max(start, stop - 1)  # the last space may belong to the next piece
            self.open += text[start:stop].encode()
            if not over:
                self._drain(out)
                return stop
            out += self.vocabulary.merged_long(self.open)
            self.kind, self.open, start = None, b"", stop
        words = pattern(text).findall(text, start, end)
        if final:
            self.encoder.closed(words, out)
            return end
        first, certain = "", end
        while words and certain + 2 > end:
            first = words.pop()
            certain -= len(first)
        self.encoder.closed(words, out)
        if len(first) > SHORT:
            last = first[-1]
            self.kind = next(k for k in (LETTERS, DIGITS, SPACES, SIGNS) if k.fullmatch(last))
            taken = first[:-1] if self.kind is SPACES else first
            self.open, self.due = taken.encode(), 0
            self._drain(out)
            certain += len(taken)
        return certain

    def _drain(self, out: list[int]) -> None:
        """Emits the tokens of the open piece that are final."""
        if len(self.open) < self.due:
            return
        size, ahead, at = self.vocabulary.bytes, self.vocabulary.ahead, 0
        for i in self.vocabulary.merged_long(self.open):
            stop = at + len(size[i])
            if stop + ahead[i] > len(self.open):
                break
            at = stop
            out.append(i)
        self.open = self.open[at:]
        self.due = 2 * len(self.open) + SHORT


class Decoder:
    """Takes ids, gives text: characters come out when their last byte has come in."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = vocabulary.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def put(self, ids) -> str:
        known = self.bytes
        return self.state.decode(b"".join([known[i] for i in ids]))

    def end(self) -> str:
        return self.state.decode(b"", final=True)


@functools.lru_cache(maxsize=4)
def vocabulary(name: str | None = None) -> Vocabulary:
    return Vocabulary(vocabulary_path(name))


@functools.lru_cache(maxsize=1)
def worker_encoder(name: str | None = None) -> Encoder:
    """The encoder of a Python worker: the pieces it remembers, a bounded number, serve its next tasks too."""
    return Encoder(vocabulary(name))


@functools.lru_cache(maxsize=1)
def _decimal() -> list[str]:
    return [str(i) for i in range(1 << 18)]


def digests(encoder: Encoder, text: str, at_once: int = 4_096) -> tuple[int, str, str]:
    """``n_tokens, ids_sha256, decoded_sha256`` of a text, in portions of about ``at_once`` ids."""
    n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(encoder.vocabulary)
    held: list[int] = []
    decimal = _decimal()

    def flush() -> None:
        nonlocal n
        if held:
            ids_hash.update((("," if n else "") + ",".join([decimal[i] for i in held])).encode())
            text_hash.update(decoder.put(held).encode())
            n += len(held)
            held.clear()

    for ids in encoder.pieces(text):
        held += ids
        if len(held) >= at_once:
            flush()
    flush()
    text_hash.update(decoder.end().encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def digested(parts: Iterator[pd.Series], name: str | None = None) -> Iterator[pd.DataFrame]:
    """``digests`` of the texts of a task; null ones are empty."""
    encoder = worker_encoder(name)
    for part in parts:
        yield pd.DataFrame([digests(encoder, t or "") for t in part], columns=["n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(text: Column, name: str | None = None) -> Column:
    @F.pandas_udf(OUT)
    def coded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return digested(texts, name)

    return coded.asNondeterministic()(text)


def encode(docs: DataFrame, text_col: str, ids_col: str = "ids", name: str | None = None) -> DataFrame:
    """The rows with a column of token ids; null texts have none."""

    @F.pandas_udf("array<int>")
    def coded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = worker_encoder(name)
        for part in texts:
            yield pd.Series([[i for p in encoder.pieces(t or "") for i in p] for t in part], dtype=object)

    return docs.withColumn(ids_col, coded.asNondeterministic()(F.col(text_col)))


def decode(rows: DataFrame, ids_col: str, text_col: str = "text", name: str | None = None) -> DataFrame:
    """The rows with the text of a column of token ids; null lists are empty."""

    @F.pandas_udf("string")
    def made(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in lists:
            out = []
            for ids in part:
                d = Decoder(vocabulary(name))
                out.append(d.put([int(i) for i in (ids if ids is not None else [])]) + d.end())
            yield pd.Series(out, dtype=object)

    return rows.withColumn(text_col, made.asNondeterministic()(F.col(ids_col)))


def encoded(docs: DataFrame, id_col: str, text_col: str, name: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row."""
    return docs.select(F.col(id_col).alias("doc_id"), round_trip(F.col(text_col), name).alias("r")).select("doc_id", "r.*")
