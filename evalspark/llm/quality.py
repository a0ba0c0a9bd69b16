"""Quality rules as weak supervision.

Rules look at counts of a text and vote for good, for bad, or abstain. How often each
rule votes which way on good and on bad texts is estimated by expectation-maximisation
over the votes of all documents, without any label: they are counted by pattern of
votes first, of which there are at most 3 to the number of rules. A document is kept if
its posterior probability of being good reaches the threshold, not if all rules agree.

Defined results: a null or empty text has zero words and fails the base rules; where no
text can be judged (an empty table), every rule keeps its prior accuracy; repeated rows
are counted and judged each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long, n_capitals long, n_marks long, n_ended long, n_alpha_words long, n_echoes long"
)
NAMES = [f.split()[0] for f in FEATURES.split(", ")]
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
ENDS = (b".", b"!", b"?", b":", b'"', b"\xe2\x80\x9d", b"\xe2\x80\xa6")


def _repeated(h: np.ndarray, window: int = WINDOW) -> int:
    """Words, given as hashes, in windows that are found at least twice, the first place included."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    w = np.zeros(n, dtype=np.uint64)
    for j in range(window):
        w = w * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    steps = np.zeros(len(h) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _CAPITALS + _CAPITALS.lower()
_ASCII = bytes(range(128))
# Of each byte: white space, a letter (or part of one) or usual punctuation, or a symbol.
_KINDS = bytes(32 if c in SPACES else 97 if c >= 0x80 or c in _LETTERS or c in b".,;:!?)\"'" else 36 for c in range(256))


def _without(b: bytes, some: bytes) -> int:
    """How many bytes of ``b`` are among ``some``."""
    return len(b) - len(b.translate(None, some))


def features_of(text: str | None) -> tuple[int, ...]:
    """The counts named in ``FEATURES``; characters beyond ASCII count as letters."""
    if not text:
        return (0,) * len(NAMES)
    b = text.encode()
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    kinds = b.translate(_KINDS)
    return (
        len(words),
        len(text) - _without(b, SPACES),
        _without(b, SYMBOLS),
        len(lines) - len(set(lines)),
        _repeated(h),
        len(lines),
        _without(b, _LETTERS) + len(text) - _without(b, _ASCII),
        _without(b, _CAPITALS),
        b.count(b"!") + b.count(b"?"),
        sum(x.rstrip().endswith(ENDS) for x in lines),
        len(words) - kinds.count(b"$ ") - kinds.endswith(b"$"),  # words that don't end in a symbol
        int((h[1:] == h[:-1]).sum()),
    )


def features(text: Column) -> Column:
    @F.pandas_udf(FEATURES)
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame(np.array([features_of(t) for t in part], dtype=np.int64).reshape(-1, len(NAMES)), columns=NAMES)

    return counted.asNondeterministic()(text)  # so that no filter runs it a second time


@dataclass(frozen=True)
class Rule:
    """Votes bad from ``bad`` on, good up to ``good``, and abstains in between.

    The measure is ``share`` of ``of``; with ``low`` it is bad up to ``bad`` and good from
    ``good`` on. Without anything to measure against, the rule abstains.
    """

    name: str
    share: str
    of: str
    good: float
    bad: float

    def vote(self) -> Column:
        x = F.col(self.share) / F.col(self.of)
        if self.good > self.bad:
            v = F.when(x >= self.good, 1).when(x <= self.bad, -1).otherwise(0)
        else:
            v = F.when(x <= self.good, 1).when(x >= self.bad, -1).otherwise(0)
        return F.when(F.col(self.of) == 0, 0).otherwise(v).cast("int")


RULES = (
    Rule("length", "n_words", "n_texts", 50, 20),
    Rule("symbols", "n_symbols", "n_words", 0.02, 0.1),
    Rule("repeats", "n_repeat_words", "n_words", 0.25, 0.4),
    Rule("same_lines", "n_dup_lines", "n_lines", 0.35, 0.6),
    Rule("capitals", "n_capitals", "n_letters", 0.15, 0.4),
    Rule("word_length", "word_chars", "n_words", 9, 14),
    Rule("marks", "n_marks", "n_words", 0.03, 0.15),
    Rule("sentence_ends", "n_ended", "n_lines", 0.6, 0.2),
    Rule("echoes", "n_echoes", "n_words", 0.03, 0.15),
    Rule("plain_words", "n_alpha_words", "n_words", 0.85, 0.6),
)


def votes(features: DataFrame, rules=RULES) -> DataFrame:
    """Add ``_v0 ...``, a vote in {-1, 0, 1} for each rule."""
    whole = features.withColumn("n_texts", F.lit(1))
    return whole.withColumns({f"_v{j}": r.vote() for j, r in enumerate(rules)}).drop("n_texts")


@dataclass
class VoteModel:
    """Log odds of good: a prior, and one number for each rule and vote."""

    prior: float
    weights: np.ndarray  # rules x 3, votes -1, 0, 1

    def posterior(self) -> Column:
        odds = F.lit(float(self.prior))
        for j, (bad, none, good) in enumerate(self.weights.tolist()):
            v = F.col(f"_v{j}")
            odds = odds + F.when(v < 0, bad).when(v > 0, good).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame, rules: int = len(RULES), rounds: int = 200, trust: float = 20.0) -> VoteModel:
    """Estimate all rules from the counts of vote patterns over every row.

    A pattern starts as bad if any rule says so. ``trust`` is the weight, in documents, of
    the prior belief about each rule: a good text hardly ever offends it, a bad one every
    fifth time, since there are several ways to be bad.
    """
    names = [f"_v{j}" for j in range(rules)]
    found = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** rules
    return fit_patterns(np.array([[r[c] for c in names] for r in found], dtype=np.int64).reshape(-1, rules), np.array([r["n"] for r in found], dtype=np.float64), rounds, trust)


def fit_patterns(patterns: np.ndarray, n: np.ndarray, rounds: int = 200, trust: float = 20.0) -> VoteModel:
    rules = patterns.shape[1]
    prior_good = np.tile(np.array([0.005, 0.2, 0.795]) * trust, (rules, 1))
    prior_bad = np.tile(np.array([0.2, 0.2, 0.6]) * trust, (rules, 1))
    good = np.where((patterns < 0).any(axis=1), 0.05, 0.95)
    order = np.lexsort(patterns.T[::-1]) if len(patterns) else np.zeros(0, dtype=np.int64)
    patterns, n, good = patterns[order], n[order], good[order]  # sums don't depend on the order of arrival
    last = None
    for _ in range(rounds):
        share = ((n * good).sum() + trust / 2) / (n.sum() + trust)
        weights = np.zeros((rules, 3))
        for v in range(3):
            hit = (patterns == v - 1) * n[:, None]
            p = ((hit * good[:, None]).sum(axis=0) + prior_good[:, v]) / ((n * good).sum() + trust)
            q = ((hit * (1 - good)[:, None]).sum(axis=0) + prior_bad[:, v]) / ((n * (1 - good)).sum() + trust)
            weights[:, v] = np.log(p / q)
        prior = float(np.log(share / (1 - share)))
        odds = prior + weights[np.arange(rules), patterns + 1].sum(axis=1)
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if last is not None and np.abs(weights - last).max() < 1e-6:
            break
        last = weights
    return VoteModel(prior, weights)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(voted: DataFrame, model: VoteModel, threshold: float = 0.2) -> DataFrame:
    """Add ``base_failed, posterior, kept`` to rows with features and votes.

    By default a text goes only if it is more than four times as probably bad as good.
    """
    out = voted.withColumn("base_failed", base_failed()).withColumn("posterior", model.posterior())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
