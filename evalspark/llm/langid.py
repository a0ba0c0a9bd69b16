"""Language identification by mixtures: a text may hold several languages.

Each language has a smoothed distribution of hashed character trigrams, learned from a
sample of labelled rows. A word's likelihood under a language is that of its trigrams,
with a boundary on either side. Expectation-maximisation finds, for each text, the
proportions of the languages among its words that make it most likely; sets of
languages compete by likelihood less a penalty for each language beyond the first. The
answer is the language with the largest proportion in the best set.

The sample is the only bounded thing: about ``per_language`` rows of each language,
drawn by a hash of the id (a documented parameter). Predictions read whole texts and
nothing else.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so
is every text if nothing was learned; ties go to the language first in order; repeated
rows get equal answers; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import held_out, portions

BITS = 16
LETTERS_AT_ONCE = 300_000
MOST_LANGUAGES = 2_000
OUT = "lang_pred string, score double, languages string, fit double"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after the other: trigram bins, the first bin of each word, each word's text.

    A word is a run of letters; it has one trigram around each of its letters.
    """
    joined = "\n".join(["", *texts, ""]).lower()
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    line = np.cumsum(c == 10) - 1  # texts hold no line feed, see below
    letter = _is_letter()[c]
    c = np.where(letter, c, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    h = c[at - 1] * np.uint64(0x9E3779B1) + c[at] * np.uint64(0x85EBCA77C2B2AE63) + c[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bins = (h >> np.uint64(64 - BITS)).astype(np.int64)
    first = np.flatnonzero(~letter[at - 1])
    return bins, first, line[at[first]]


def _plain(text: str) -> str:
    return text.replace("\n", " ")


@dataclass
class LanguageModel:
    languages: list[str]
    logs: np.ndarray  # bins x languages, log probabilities

    def predict(self, texts: list[str | None], penalty: float = 4.0, rounds: int = 25) -> list[tuple[str, float, str, float]]:
        answers: list[tuple] = [("und", 0.0, "", 0.0)] * len(texts)
        if not self.languages:
            return answers
        wanted = [(i, _plain(t)) for i, t in enumerate(texts) if t]
        for part in portions(wanted, lambda x: len(x[1]), min(LETTERS_AT_ONCE, 16 * LETTERS_AT_ONCE // len(self.languages))):
            for (i, _), answer in zip(part, self._portion([t for _, t in part], penalty, rounds)):
                answers[i] = answer
        return answers

    def _portion(self, texts: list[str], penalty: float, rounds: int) -> list[tuple]:
        n, k = len(texts), len(self.languages)
        bins, first, of = trigrams(texts)
        out: list[tuple] = [("und", 0.0, "", 0.0)] * n
        if not len(first):
            return out
        logs = np.add.reduceat(self.logs[bins], first, axis=0).astype(np.float64)
        top = logs.max(axis=1)
        like = np.exp(np.maximum(logs - top[:, None], -60.0))
        docs, start, words = np.unique(of, return_index=True, return_counts=True)  # words lie in order of their texts
        base = np.add.reduceat(top, start)
        single = np.add.reduceat(logs, start, axis=0)
        letters = np.add.reduceat(np.diff(np.append(first, len(bins))), start)
        best_share = np.eye(k)[single.argmax(axis=1)]
        best = single.max(axis=1)
        cost = penalty * np.log(words + 1.0)
        all_share, all_fit = _mixture(like, start, words, np.full((len(docs), k), 1.0 / k), rounds)
        rank = np.argsort(np.argsort(-all_share, axis=1, kind="stable"), axis=1, kind="stable")
        going = np.flatnonzero(all_fit + base - cost > best)  # no set can be likelier than all languages together
        size = 2
        while len(going) and size <= k:
            rows = np.concatenate([np.arange(start[g], start[g] + words[g]) for g in going])
            begin = np.concatenate([[0], np.cumsum(words[going])[:-1]])
            allowed = (rank[going] < size) / size
            share, fit = _mixture(like[rows], begin, words[going], allowed, rounds)
            gain = fit + base[going] - cost[going] * (size - 1)
            better = gain > best[going]
            best[going[better]] = gain[better]
            best_share[going[better]] = share[better]
            size += 1
            going = going[(all_fit + base - cost * (size - 1))[going] > best[going]]
        for j, d in enumerate(docs):
            share = best_share[j]
            i = int(share.argmax())
            found = ",".join(f"{self.languages[x]}:{share[x]:.3f}" for x in np.argsort(-share, kind="stable") if share[x] >= 0.0005)
            out[d] = (self.languages[i], float(min(1.0, share[i])), found, float(best[j] / letters[j]))
        return out


def _mixture(like: np.ndarray, start: np.ndarray, words: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text after expectation-maximisation, and its log likelihood."""
    for _ in range(rounds):
        parts = like * np.repeat(share, words, axis=0)
        parts /= np.maximum(parts.sum(axis=1), 1e-300)[:, None]
        last, share = share, np.add.reduceat(parts, start, axis=0) / words[:, None]
        if np.abs(share - last).max() < 1e-3:
            break
    sums = np.einsum("ij,ij->i", like, np.repeat(share, words, axis=0))
    return share, np.add.reduceat(np.log(np.maximum(sums, 1e-300)), start)


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = 400, smoothing: float = 0.05) -> LanguageModel:
    """Learn from rows that have a language and are not held out.

    What reaches the driver is one count per language and one per language and hash bin.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), dtype=np.float32))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, per_language / sizes[lang])))])
    sample = rows.filter(F.col("text").isNotNull() & (draw < share[F.col("lang")])).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = sums.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                counts += np.bincount(trigrams([_plain(text)])[0], minlength=1 << BITS)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bin", "n"])

    counted = sample.mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # at most 65,536 rows per language
    n = np.zeros((1 << BITS, len(languages)))
    n[found["bin"].to_numpy(dtype=np.int64), found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    total = n.sum(axis=0)
    learned = total > 0  # a language without a single letter can't be told
    n, languages = n[:, learned], [x for x, y in zip(languages, learned) if y]
    logs = np.log((n + smoothing) / (total[learned] + smoothing * len(n)))
    return LanguageModel(languages, logs.astype(np.float32))


def predicted(text: Column, model: LanguageModel, penalty: float = 4.0) -> Column:
    """``lang_pred, score, languages, fit`` of a text; fit is the mean log likelihood per letter."""
    shared = _broadcast(model)

    @F.pandas_udf(OUT)
    def answers(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame(shared.value.predict(list(part), penalty), columns=["lang_pred", "score", "languages", "fit"])

    return answers.asNondeterministic()(text)


def _broadcast(model: LanguageModel):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(model)  # bins x languages numbers


def identify(docs: DataFrame, model: LanguageModel, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages, fit`` of each row."""
    answer = docs.select(F.col(id_col).alias("doc_id"), predicted(F.col(text_col), model).alias("_answer"))
    return answer.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_answer.*")
