"""Secret scan: three fixed patterns, and tests of randomness on what they leave.

Candidates are runs of letters, digits and ``+ / _ = -`` of ``LEAST`` characters or more, and
the parts of so many characters between their separators. The alphabet is inferred from the
characters that occur, letters of one case included. Under it, a battery tests
whether the characters look drawn at random: chi-squared for uniform use of the alphabet,
the runs test about its middle, and serial correlation at lag one; Fisher's method joins
the three. Words pass such tests too, the easier the shorter they are. So each candidate
is held against the corpus's own short words, which random strings are too long to be among:
the likelihood ratio of their character trigrams to equal use of the alphabet bounds the
p-value under "a natural string". Within each alphabet and class of lengths the false
discovery rate is then held by the Benjamini-Hochberg rule over all candidates of the corpus;
one that fails the battery has p-value one. Only counts of trigrams, and per
alphabet, class and score bin, reach the driver.

Defined results: a null text is empty and has no spans; repeated rows are counted and
reported each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import portions
from evalspark.plans.storage import cut

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")

LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
PART = re.compile(r"[A-Za-z0-9]{%d,}" % LEAST)
SEPARATORS = str.maketrans("", "", "+/_=-")
BINS = 64
LENGTHS = (12, 16, 20, 24, 32, 48, 64, 128)  # lower ends of the classes
ENCODINGS = ("letters", "hex", "base32", "base36", "base62", "base64")
SYMBOLS = (26, 16, 32, 36, 62, 64)
LETTERS = 0
CODES = 28  # of trigrams: all else, the letters, a digit

BASE = "n_assign long, n_access long, n_hex long, base array<struct<kind:int,start:long,end:long>>, base_sha256 string"
FOUND = f"{BASE}, candidates array<struct<start:long,end:long,encoding:int,length:int,bin:int,within:int,within_bin:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by start, then kind; whole matches, in code points."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], s[0]))


def covered(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans, in order of their starts, cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def encoding_of(s: str) -> int | None:
    """The smallest alphabet that fits, or None for strings that are no candidates (numbers, rulers)."""
    body = s.rstrip("=")
    digits, letters = re.search(r"[0-9]", body), re.search(r"[A-Za-z]", body)
    if not letters:
        return None
    if re.search(r"[+/_=-]", body):
        if re.search(r"[a-z]", body) and re.search(r"[A-Z]", body):
            return 5
        body = body.translate(SEPARATORS)
    if not digits:
        if body.islower() or body.isupper() or body[1:].islower():
            return LETTERS
        return 4
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        return 1
    if re.fullmatch(r"[A-Z2-7]+", body):
        return 2
    return 3 if re.fullmatch(r"[0-9a-z]+|[0-9A-Z]+", body) else 4


_HEX = {c: i for i, c in enumerate("0123456789abcdef")} | {c: i for i, c in enumerate("0123456789ABCDEF")}
_ALPHABETS = (
    {c: ord(c.lower()) - 97 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"},
    _HEX,
    {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")},
    {c: int(c, 36) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"},
    {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")},
    {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")} | {"-": 62, "_": 63},
)
_TABLES = np.zeros((len(_ALPHABETS), 128), dtype=np.int64)
for _i, _alphabet in enumerate(_ALPHABETS):
    for _c, _v in _alphabet.items():
        _TABLES[_i, ord(_c)] = _v


_CODE = np.zeros(256, dtype=np.int64)  # of bytes
for _c in range(26):
    _CODE[ord("a") + _c] = _CODE[ord("A") + _c] = 1 + _c
_CODE[ord("0") : ord("9") + 1] = 27
# Share of each code where the characters of an alphabet are drawn at random.
_DRAWN = np.ones((len(ENCODINGS), CODES))
for _i, (_letter, _digit) in enumerate([(1 / 26, 1), (1 / 16, 10 / 16), (1 / 32, 6 / 32), (1 / 36, 10 / 36), (2 / 62, 10 / 62), (2 / 64, 10 / 64)]):
    _DRAWN[_i, 1:27], _DRAWN[_i, 27] = _letter, _digit


def trigram_counts(text: bytes) -> np.ndarray:
    """Of the words of less than ``LEAST`` letters and digits, each with what stands before it."""
    code = np.concatenate([[0, 0], _CODE[np.frombuffer(text, dtype=np.uint8)], [0]])
    edge = np.flatnonzero(np.diff(code != 0))  # the last place before each word, and its last place
    long = np.flatnonzero(edge[1::2] - edge[::2] >= LEAST)
    for a, b in zip(edge[::2][long], edge[1::2][long]):
        code[a + 1 : b + 1] = -1
    kept = (code[2:] > 0) & (code[1:-1] >= 0)
    before = np.where(code[1:-1] > 0, code[:-2], 0)
    return np.bincount((before * CODES * CODES + code[1:-1] * CODES + code[2:])[kept], minlength=CODES**3)


def word_model(counts: np.ndarray, weight: float = 50.0, loose: float = 0.1) -> np.ndarray:
    """Probability of a code after two others, leaning on shorter contexts where these are rare.

    A share ``loose`` is spread evenly, so that no single odd trigram decides.
    """
    n = counts.reshape(CODES, CODES, CODES).astype(np.float64)
    even = np.full(CODES, 1 / (CODES - 1))
    one = (n.sum(axis=(0, 1)) + weight * even) / (n.sum() + weight)
    two = (n.sum(axis=0) + weight * one) / (n.sum(axis=(0, 2))[:, None] + weight)
    three = (n + weight * two) / (n.sum(axis=2)[:, :, None] + weight)
    return (1 - loose) * three + loose * even


def learn(docs: DataFrame, text_col: str) -> np.ndarray:
    """The word model of all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES**3, dtype=np.int64)
        for batch in batches:
            for part in portions((t.encode() for t in batch.column(0).to_pylist() if t), len, 1 << 20):
                total += trigram_counts(b"\n".join(part))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["gram", "n"])

    found = docs.select(text_col).mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most CODES ** 3
    counts = np.zeros(CODES**3)
    for r in found:
        counts[r["gram"]] = r["n"]
    return word_model(counts)


def naturalness(strings: list[str], encodings: list[int], model: np.ndarray) -> np.ndarray:
    """Log2 of the likelihood of each string among the corpus's words to that of random characters.

    Under the word model ``2 ** -x`` bounds the chance of a value of ``-x`` or less.
    """
    code = _CODE[np.frombuffer("".join(f"  {s}" for s in strings).encode(), dtype=np.uint8)]
    of = np.repeat(np.arange(len(strings)), [len(s) + 2 for s in strings])
    at = np.flatnonzero(code)
    before = np.where(code[at - 1] > 0, code[at - 2], 0)
    ratio = np.log2(model[before, code[at - 1], code[at]] / _DRAWN[np.array(encodings, dtype=np.int64)[of[at]], code[at]])
    return np.bincount(of[at], weights=ratio, minlength=len(strings))


def _upper_tail(z: np.ndarray) -> np.ndarray:
    """Of the standard normal distribution, by the erfc approximation of Abramowitz and Stegun (7.1.26)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * np.exp(-x * x)
    return np.where(z >= 0, half, 1 - half)


def randomness(strings: list[str], encodings: list[int]) -> np.ndarray:
    """Joint p-value of the battery for each string: small where it doesn't look random."""
    if not strings:
        return np.zeros(0)
    bodies = [s.rstrip("=") for s in strings]
    n = np.array([len(b) for b in bodies], dtype=np.float64)
    start = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    of = np.repeat(np.arange(len(bodies)), n.astype(np.int64))
    enc = np.array(encodings)
    code = _TABLES[enc[of], np.frombuffer("".join(bodies).encode(), dtype=np.uint8)]
    k = np.array(SYMBOLS, dtype=np.float64)[enc]
    # Chi-squared against equal use of all symbols, by the Wilson-Hilferty approximation.
    counts = np.bincount(of * 64 + code, minlength=64 * len(bodies)).reshape(-1, 64).astype(np.float64)
    chi, df = (counts**2).sum(axis=1) * k / n - n, k - 1
    p_chi = _upper_tail((np.cbrt(chi / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df)))
    # Runs above and below the middle of the alphabet.
    above = code >= (k / 2)[of]
    same_string = of[1:] == of[:-1]
    changes = np.bincount(of[1:], weights=(above[1:] != above[:-1]) & same_string, minlength=len(bodies))
    high = np.add.reduceat(above.astype(np.float64), start)
    low = n - high
    both = np.maximum(2 * high * low, 1e-9)
    mean, spread = both / n + 1, np.sqrt(np.maximum(both * (both - n) / (n * n * np.maximum(n - 1, 1)), 1e-9))
    p_runs = np.where((high > 1) & (low > 1), 2 * _upper_tail(np.abs((changes + 1 - mean) / spread)), 1e-12)
    # Serial correlation at lag one.
    centred = code - (np.add.reduceat(code.astype(np.float64), start) / n)[of]
    square = np.add.reduceat(centred**2, start)
    products = np.bincount(of[1:], weights=centred[1:] * centred[:-1] * same_string, minlength=len(bodies))
    p_serial = np.where(square > 0, 2 * _upper_tail(np.abs(products / np.maximum(square, 1e-9) + 1 / n) * np.sqrt(n)), 1e-12)
    x = -2 * sum(np.log(np.clip(p, 1e-12, 1.0)) for p in (p_chi, p_runs, p_serial))
    return np.exp(-x / 2) * (1 + x / 2 + x * x / 8)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs, and the parts of those with separators."""
    for m in CANDIDATE.finditer(text):
        yield m.span()
        for part in PART.finditer(m[0]):
            if part.span() != (0, len(m[0])):
                yield m.start() + part.start(), m.start() + part.end()


def scan(text: Column, model: np.ndarray, least_random: float = 1e-3) -> Column:
    """The base spans of a text, and its candidates with their scores.

    A candidate's bin falls with its p-value under "a natural string", a power of two; in the
    last one are those whose randomness is below ``least_random``.
    """

    @F.pandas_udf(FOUND)
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            rows, strings, encodings = [], [], []
            for t in part:
                t = t or ""
                base = base_spans(t)
                starts, ends = covered(base)
                here = []
                run, run_end = None, 0  # the run that the present parts lie in, if it is a candidate
                for a, b in candidates(t):
                    whole = a >= run_end
                    if whole:
                        run, run_end = None, b
                    i = bisect_right(ends, a)
                    e = None if i < len(ends) and starts[i] < b else encoding_of(t[a:b])
                    if e is not None:
                        here.append((a, b, e, len(strings), run))
                        if whole:
                            run = here[-1]
                        strings.append(t[a:b])
                        encodings.append(e)
                kinds = [k for k, _, _ in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in range(3)), base, digest, here))
            bodies = [x if e == 5 else x.translate(SEPARATORS) for x, e in zip(strings, encodings)]
            odd = np.clip(-naturalness(strings, encodings, model), 0, BINS - 1).astype(np.int64)
            score = BINS - 1 - np.where(randomness(bodies, encodings) >= least_random, odd, 0)
            yield pd.DataFrame(
                [
                    (*r[:3], [{"kind": k, "start": a, "end": b} for k, a, b in r[3]], r[4],
                     [{"start": a, "end": b, "encoding": e, "length": _length_class(b - a), "bin": int(score[i]),
                       "within": _class_of(run) if run else -1, "within_bin": int(score[run[3]]) if run else BINS} for a, b, e, i, run in r[5]])
                    for r in rows
                ],
                columns=["n_assign", "n_access", "n_hex", "base", "base_sha256", "candidates"],
            )

    return scanned.asNondeterministic()(text)


def _class_of(candidate: tuple) -> int:
    a, b, e = candidate[:3]
    return e * 100 + _length_class(b - a)


def _length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def thresholds(scanned: DataFrame, rate: float = 0.05, least: int = 10) -> dict[tuple[int, int], int]:
    """The last accepted score bin of each encoding and class of lengths, over all rows.

    P-values above ``2 ** -least`` are never accepted.
    """
    found = (
        scanned.select(F.explode("candidates").alias("c")).groupBy("c.encoding", "c.length", "c.bin").agg(F.count("*").alias("n")).collect()
    )  # at most encodings x classes x bins
    counts = np.zeros((len(ENCODINGS), len(LENGTHS), BINS))
    for r in found:
        counts[r["encoding"], r["length"], r["bin"]] = r["n"]
    p = 2.0 ** -np.arange(BINS - 1, -1, -1)
    out = {}
    for encoding in range(len(ENCODINGS)):
        for length in range(len(LENGTHS)):
            accepted = np.cumsum(counts[encoding, length])
            good = np.flatnonzero((accepted > 0) & (p * accepted[-1] <= rate * accepted) & (p <= 2.0**-least))
            if len(good):
                out[encoding, length] = int(good[-1])
    return out


def with_spans(scanned: DataFrame, accepted: dict[tuple[int, int], int]) -> DataFrame:
    """Add ``found``, all spans by start and kind, as structs ``(start, kind, end)``."""
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    if not accepted:
        return scanned.withColumn("found", F.array_sort(base))
    limit = F.create_map(*[F.lit(x) for (e, n), b in sorted(accepted.items()) for x in (e * 100 + n, b)])

    def passes(kind: Column, score: Column) -> Column:
        return score <= F.coalesce(limit[kind], F.lit(-1))

    # A part of a run that passes is left to the run.
    passed = F.filter("candidates", lambda c: passes(c["encoding"] * 100 + c["length"], c["bin"]) & ~passes(c["within"], c["within_bin"]))
    more = F.transform(passed, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.withColumn("found", F.array_sort(F.concat(base, more)))


def span_text(found: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str, text_col: str, rate: float = 0.05) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of each row. Texts are read twice."""
    model = learn(docs, text_col)
    scanned = cut(docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col), model).alias("r")).select("doc_id", "r.*"))
    done = with_spans(scanned, thresholds(scanned, rate))
    return done.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", span_text("found").alias("spans"))


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with a mark in place of each span; overlapping spans share one."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans):
            if t is not None and s is not None and len(s):
                parts, at = [], 0
                for a, b in sorted((x["start"], x["end"]) for x in s):
                    if a >= at:
                        parts += [t[at:a], mark]
                    at = max(at, b)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    return cleaned.asNondeterministic()(text, found)
