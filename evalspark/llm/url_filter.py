"""URL filter: hand-written host and path rules, else a logistic regression.

The model scores hashed character n-grams of the host and of the path. It is fitted on
a small labelled table of URLs, at most ``max_rows`` of them (a documented bound: those
with the smallest hash), by full-batch gradient descent on the driver. What it needs at
run time is one weight per hash bin, whatever the size of the table that it judges.

Defined results: a null URL or one without ``://`` has an empty host and path and is
judged by the method; repeated URLs get equal verdicts; an empty table gives no rows;
further columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words of hosts that a person marked as unwanted or as ordinary. None is a host of the test tables.
UNWANTED = (
    "casino-play casino-royal online-casino big-win win-cash lucky-win mega-win poker-room slot-machines "
    "free-slots sports-bets betting-tips bet-now cheap-meds cheap-loans online-pills "
    "diet-pills pills-store adult-video adult-chat xxx-tube porn-hub sex-cam hot-dating spam-links "
    "spam-mail link-farm content-farm ads-serve ads-click click-track popup-ads track-pixel "
    "free-money free-crack payday-loan replica-watch warez-crack torrent-free lottery-win jackpot-city escort-live"
).split()
ORDINARY = (
    "news daily-news library museum university school-board city-council weather science journal recipes garden "
    "history travel-notes music-review theatre books bookshop health-service hospital research institute archive "
    "encyclopedia tutorial docs developer support forum community local-paper photo-club chess-club football-club "
    "railway harbour mountain-hut kitchen teacher student therapy other thread theory nation station motion edition "
    "thing anthem earth northern tradition section rhythm handbook standard weekly monthly"
).split()

# Folders and files of paths, marked the same way.
UNWANTED_PATHS = (
    "online-casino casino-bonus casino/slots play-slots jackpot-win poker-bonus roulette-online sports-betting bet-bonus betting-odds "
    "buy-viagra cheap-viagra buy-pills pills-online weight-loss-pills order-meds no-prescription payday-loans cheap-loans "
    "porn-videos free-porn xxx-videos adult-videos adult-dating sex-chat live-sex hot-girls escort-girls nude-cams "
    "replica-watches fake-rolex warez-download crack-keygen free-torrent lottery-winner win-money free-spins "
    "earn-money-fast make-money-fast crypto-giveaway click-here-win popup-ads spam-links buy-backlinks cheap-backlinks"
).split()
ORDINARY_PATHS = (
    "news/local about-us opening-hours annual-report contact-form research-papers lecture-notes book-review history-of-art "
    "city-council school-lunch weather-report train-times garden-plants recipe-soup travel-guide music-lessons "
    "photo-album science-week chess-results football-results museum-tickets library-catalogue privacy-policy "
    "press-release video-lessons adult-education sex-education health-advice loan-desk download-form free-entry "
    "online-course live-concert money-matters playground-rules winter-hours order-books game-rules letters winners-of-the-prize "
    "documentation/install forum/threads article/views"
).split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table ``(url, label)``: 1 for unwanted hosts and paths, 0 for ordinary ones.

    Each word of a host stands once for each kind of address, so that prefix, country ending,
    language and number occur with both labels. Unwanted and ordinary paths stand on the same
    ordinary hosts, so that there the path alone tells the label. Further ordinary addresses
    make a URL without any sign an ordinary one.
    """
    prefixes, langs = ("", "www.", "blog.", "m."), ("en", "de", "fr", "es")
    rows = []
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for i, word in enumerate(words):
            for j, prefix in enumerate(prefixes):
                end = ("com", "net", "org")[(i + j) % 3]
                rows.append((f"https://{prefix}{word}.example.{end}/{langs[(i + j) % 4]}/{(37 * i + 11 * j) % 997}{('', '.html')[(i + j) % 2]}", label))
    for i in range(max(len(UNWANTED_PATHS), len(ORDINARY_PATHS))):
        for label, paths in ((1, UNWANTED_PATHS), (0, ORDINARY_PATHS)):
            path = paths[i % len(paths)]
            for j, prefix in enumerate(prefixes):
                host = f"{prefix}{ORDINARY[(5 * i + 13 * j) % len(ORDINARY)]}.example.{('com', 'net', 'org')[(i + j) % 3]}"
                rest = (path, f"{path}/{(37 * i) % 997}", f"{langs[i % 4]}/{path}", f"{langs[i % 4]}/{path}/{(53 * i) % 997}.html")[j]
                rows.append((f"https://{host}/{rest}", label))
    for i, word in enumerate(ORDINARY):  # without a sign a URL is an ordinary one
        host = [f"https://{prefix}{word}.example.{('com', 'net', 'org')[(i + 2 * j) % 3]}" for j, prefix in enumerate(prefixes)]
        for j in range(8):
            rows.append((f"{host[(i + j) % 4]}/{langs[j % 4]}/{(71 * i + 29 * j) % 997}{('', '.html')[j // 4]}", 0))
            slug = f"{ORDINARY[(3 * i + 17 * j + 1) % len(ORDINARY)]}-{ORDINARY[(5 * i + 7 * j + 2) % len(ORDINARY)]}"
            rows.append((f"{host[(i + j) % 4]}/{slug if j % 2 else ORDINARY_PATHS[(7 * i + 11 * j) % len(ORDINARY_PATHS)]}", 0))
    for i, word in enumerate(UNWANTED):  # nor does an ordinary path excuse its host
        for j, prefix in enumerate(prefixes):
            rows.append((f"https://{prefix}{word}.example.{('com', 'net', 'org')[(i + 2 * j) % 3]}/{ORDINARY_PATHS[(3 * i + 11 * j) % len(ORDINARY_PATHS)]}", 1))
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or end; A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits; null where none does.

    A rule ``(host, path, verdict)`` fits its host and all subdomains of it, if the
    path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _bins(kind: str, s: str, sizes: Sequence[int], bits: int) -> set[int]:
    """Hash bins of the distinct n-grams of ``s``; those of host and path are kept apart."""
    s = f"^{s}$"
    grams = {s[i : i + n] for n in sizes for i in range(len(s) - n + 1)}
    return {zlib.crc32((kind + g).encode()) & ((1 << bits) - 1) for g in grams}


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...]
    bits: int

    def part(self, kind: str, s: str) -> float:
        return float(self.weights[list(_bins(kind, s, self.sizes, self.bits))].sum()) if s else 0.0


def train(labelled: DataFrame, sizes: Sequence[int] = (3, 4, 5), bits: int = 16, max_rows: int = 20_000, l2: float = 0.02, steps: int = 300) -> UrlModel:
    """Fit the regression on ``labelled (url, label)``; rows with a null in either take no part.

    Without labelled rows every weight is zero and every score one half.
    """
    rows = (
        labelled.filter(F.col("url").isNotNull() & F.col("label").isNotNull())
        .select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("host", "path"), "host", "path", "label")
        .limit(max_rows)
        .collect()  # at most max_rows
    )
    weights, bias = np.zeros(1 << bits, dtype=np.float64), 0.0
    if not rows:
        return UrlModel(weights, bias, tuple(sizes), bits)
    found = [sorted(_bins("h", r["host"], sizes, bits) | _bins("p", r["path"], sizes, bits)) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    col = np.concatenate([np.array(f) for f in found])
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))  # both labels weigh the same
    used, col = np.unique(col, return_inverse=True)
    w, step = np.zeros(len(used)), 4.0 / np.mean([len(f) for f in found])
    for _ in range(steps):
        z = np.bincount(row, weights=w[col], minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-z)) - y) * share
        w -= step * (np.bincount(col, weights=error[row], minlength=len(used)) + l2 / len(used) * w)
        bias -= step * error.sum()
    weights[used] = w
    return UrlModel(weights, float(bias), tuple(sizes), bits)


def score(host: Column, path: Column, model: UrlModel, remembered: int = 50_000) -> Column:
    """Probability that the URL is unwanted. A worker remembers the part of so many hosts."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for hosts, paths in parts:
            z = []
            for h, p in zip(hosts, paths):
                if h not in known:
                    if len(known) >= remembered:
                        known.clear()
                    known[h] = model.part("h", h)
                z.append(known[h] + model.part("p", p) + model.bias)
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, dtype=np.float64), -500, 500))))

    return scored.asNondeterministic()(host, path)


def judge(urls: DataFrame, id_col: str, url_col: str, rules: Sequence[tuple[str, str, str]], model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """``id, host, path, rule, verdict, score`` of each row."""
    url = F.col(url_col)
    parts = urls.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    scored = parts.withColumn("score", score(F.col("host"), F.col("path"), model))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score")
