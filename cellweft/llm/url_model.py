"""URL filter: two variable-order character Markov models and a calibrated ratio.

URLs that the rules decide are the labelled rows. Four fifths of them (by
CRC-32 of the URL) are counted, the rest calibrates. Characters fold to 64
classes; contexts of up to two characters are exact, those of three and four
fold to 16,384 slots each, so a model has at most 2.4 million cells whatever the
size of the table. That bound is what makes it safe to gather and broadcast.

Probabilities are interpolated from order 0 to 4 with Witten-Bell weights: a
context seen ``n`` times with ``t`` different followers gives ``t / (n + t)`` of
its mass to the next shorter one. The score of a URL is the mean over its
characters of ``log p_accepted - log p_rejected``.

Defined results: a null URL, or one without ``://``, has an empty host and path
and no rule; without characters the score is 0. If the rules decide no URL of
one class, all scores are 0 and the threshold is 0, so the verdict is allow.
Repeated rows count each time and are judged each time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cellweft.llm.common import tune

SYMBOLS = 64
EDGE = 62
OTHER = 63
SLOTS = 1 << 14
ORDER = 4
STARTS = (0, 1, 1 + SYMBOLS, 1 + SYMBOLS + SYMBOLS**2, 1 + SYMBOLS + SYMBOLS**2 + SLOTS)
CONTEXTS = STARTS[-1] + SLOTS
KNOWN = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&#:%~+@,;!$'()*[]| "
BINS = 4001
BIN_WIDTH = 0.005


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that the query applies.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

_CLASS = np.full(256, OTHER, np.int64)
for _i, _c in enumerate(KNOWN):
    _CLASS[ord(_c)] = _i
    _CLASS[ord(_c.upper())] = _i


def host_of(url: Column) -> Column:
    """Text between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def cells_of(urls) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context ids (one row per order), symbols, and the row of every character."""
    raw = [b"" if u is None else u.encode("utf-8", "surrogatepass") for u in urls]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    symbols = _CLASS[np.frombuffer((b"\xff" * ORDER).join([b"", *raw]), np.uint8)]
    rows = np.repeat(np.arange(len(raw)), lengths)
    if not len(rows):
        return np.empty((ORDER + 1, 0), np.int64), np.empty(0, np.int64), rows
    ends = np.cumsum(lengths + ORDER)
    at = np.arange(len(rows)) + ORDER * (rows + 1)
    edge = np.ones(len(symbols), bool)
    edge[at] = False
    symbols = np.where(edge, EDGE, symbols)
    assert ends[-1] == len(symbols)
    back = [symbols[at - k] for k in range(1, ORDER + 1)]
    contexts = np.empty((ORDER + 1, len(at)), np.int64)
    contexts[0] = 0
    contexts[1] = STARTS[1] + back[0]
    contexts[2] = STARTS[2] + back[1] * SYMBOLS + back[0]
    three = (back[2] * SYMBOLS + back[1]) * SYMBOLS + back[0]
    four = back[3] * SYMBOLS**3 + three
    contexts[3] = STARTS[3] + fold(three)
    contexts[4] = STARTS[4] + fold(four)
    return contexts, symbols[at], rows


def fold(x: np.ndarray) -> np.ndarray:
    """Fold packed contexts to SLOTS slots."""
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int64)


def count_cells(labelled: DataFrame) -> DataFrame:
    """(verdict, cell, n) from rows (url, verdict): each task adds up its own cells first."""

    def tally(batches):
        totals: dict[str, np.ndarray] = {}
        for pdf in batches:
            for verdict, part in pdf.groupby("verdict"):
                contexts, symbols, _ = cells_of(part["url"])
                cells = (contexts * SYMBOLS + symbols).ravel()
                totals[verdict] = totals.get(verdict, 0) + np.bincount(cells, minlength=CONTEXTS * SYMBOLS)
        for verdict, counts in totals.items():
            seen = np.flatnonzero(counts)
            yield pd.DataFrame({"verdict": verdict, "cell": seen, "n": counts[seen]})

    rows = labelled.select("url", "verdict").mapInPandas(tally, "verdict string, cell long, n long")
    return rows.groupBy("verdict", "cell").agg(F.sum("n").alias("n"))


@dataclass
class UrlModel:
    """Dense counts of one class: cells, context totals and numbers of followers."""

    counts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray

    @classmethod
    def build(cls, cells, n) -> UrlModel:
        counts = np.zeros(CONTEXTS * SYMBOLS, np.int64)
        counts[np.asarray(cells, np.int64)] = np.asarray(n, np.int64)
        by_context = counts.reshape(CONTEXTS, SYMBOLS)
        return cls(counts, by_context.sum(1), (by_context > 0).sum(1))

    def log_prob(self, contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        p = (self.counts[symbols] + 1.0) / (self.totals[0] + SYMBOLS)
        for order in range(1, ORDER + 1):
            at = contexts[order]
            n, t = self.totals[at], self.kinds[at]
            p = np.where(n > 0, (self.counts[at * SYMBOLS + symbols] + t * p) / np.maximum(n + t, 1), p)
        return np.log(p)


def ratio_scores(urls, accepted: UrlModel | None, rejected: UrlModel | None) -> np.ndarray:
    """Mean log-likelihood difference per character; 0 without characters or without a model."""
    if accepted is None or rejected is None:
        return np.zeros(len(urls))
    contexts, symbols, rows = cells_of(urls)
    gain = accepted.log_prob(contexts, symbols) - rejected.log_prob(contexts, symbols)
    lengths = np.bincount(rows, minlength=len(urls))
    return np.bincount(rows, gain, minlength=len(urls)) / np.maximum(lengths, 1)


def best_threshold(histogram: dict[str, np.ndarray], keep: float = 0.99) -> float:
    """The bin edge with the best balanced accuracy among those that keep ``keep`` of the accepted URLs.

    Among equals the one nearest 0.
    """
    allow, block = histogram["allow"], histogram["block"]
    if not allow.sum() or not block.sum():
        return 0.0
    passed = allow[::-1].cumsum()[::-1] / allow.sum()
    stopped = np.concatenate([[0], block.cumsum()[:-1]]) / block.sum()
    gain = np.where(passed >= keep, passed + stopped, -1.0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    edges = (best - BINS // 2) * BIN_WIDTH
    return float(edges[np.argmin(np.abs(edges))])


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score): the rule's verdict, else the ratio's."""
    spark = tune(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "decided": decided})
    labelled = rows.filter(F.col("decided").isNotNull()).select("url", F.col("decided").alias("verdict"))
    held = F.crc32(F.col("url").cast("binary")) % 5 == 0
    cells = count_cells(labelled.filter(~held)).toPandas()
    parts = {verdict: UrlModel.build(part["cell"], part["n"]) for verdict, part in cells.groupby("verdict")}
    shared = spark.sparkContext.broadcast((parts.get("allow"), parts.get("block")))

    def scored(batches):
        for pdf in batches:
            yield pdf.assign(score=ratio_scores(pdf["url"].tolist(), *shared.value))

    middle = F.least(F.greatest(F.floor(F.col("score") / BIN_WIDTH) + BINS // 2, F.lit(0)), F.lit(BINS - 1))
    held_out = labelled.filter(held).mapInPandas(scored, "url string, verdict string, score double")
    histogram = {verdict: np.zeros(BINS, np.int64) for verdict in ("allow", "block")}
    for row in held_out.groupBy("verdict", middle.cast("int").alias("bin")).count().collect():
        histogram[row["verdict"]][row["bin"]] = row["count"]
    threshold = best_threshold(histogram)
    result = rows.mapInPandas(scored, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    by_ratio = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return result.select("id", "host", "path", "rule", F.coalesce("decided", by_ratio).alias("verdict"), "score")
