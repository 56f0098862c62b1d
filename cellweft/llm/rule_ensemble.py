"""Quality classifier: tree paths as rules, lasso weights, one column expression.

Statistics of the whole text are the only inputs. Spark's random forest grows shallow trees on the
labelled rows; every path from a root to a node is a conjunctive rule (bounds on some
statistics). Spark's logistic regression with an L1 penalty weighs rules and clipped
statistics, and what keeps a weight is compiled into one Spark column expression.

Both fits run over all labelled rows. The number of rules is bounded by trees and depth, not by data.

Defined results: a null or empty text has all statistics 0 and a score like any other. Rows
of ``labels`` without a label are left out; an id that repeats there counts each time, as do
repeated documents. Without labelled rows of both kinds the score is the
share of label 1, or 0.5 without any.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from cellweft.llm.common import tune, written
from cellweft.llm.words import hash_words, to_bytes, windows

STATS = ("log_words", "word_length", "word_length_sd", "longest_word", "distinct_words", "top_word", "upper", "digits",
         "symbols", "exclaims", "bars", "stops", "not_ascii", "line_words", "same_lines", "repeated", "upper_words",
         "byte_entropy", "word_entropy")
_BYTES = {name: [ord(c) for c in chars] for name, chars in
          {"symbols": "#*$%&<>@^~=_{}[]\\", "exclaims": "!?", "bars": "|", "stops": ".,;:"}.items()}


def text_stats(text: str | None) -> list[float]:
    """The statistics of STATS for a whole text."""
    raw = to_bytes(text) if text else b""
    words = raw.split()
    if not words:
        return [0.0] * len(STATS)
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    lengths = np.fromiter(map(len, words), float, n)
    seen = Counter(words)
    shares = np.fromiter(seen.values(), float, len(seen)) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0.0
    if n > 3:
        grams = windows(hash_words(words), 3)
        repeated = 1.0 - len(np.unique(grams)) / len(grams)
    letters = counts[65:91].sum() + counts[97:123].sum()
    p = counts[counts > 0] / size
    return [math.log1p(n), lengths.mean(), lengths.std(), math.log1p(lengths.max()), len(seen) / n, shares.max(),
            counts[65:91].sum() / max(letters, 1), counts[48:58].sum() / size,
            *[counts[_BYTES[k]].sum() / size for k in ("symbols", "exclaims", "bars", "stops")],
            counts[128:].sum() / size, math.log1p(n / len(lines)), 1.0 - len(set(lines)) / len(lines), repeated,
            sum(map(bytes.isupper, words)) / n, float(-(p * np.log2(p)).sum()),
            float(-(shares * np.log2(shares)).sum() / math.log2(n + 1))]


def measure(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, statistics), one row per document, in a written copy."""

    def run(batches):
        for pdf in batches:
            found = np.array([text_stats(t) for t in pdf["text"]], float).reshape(len(pdf), len(STATS))
            yield pd.concat([pdf[["id"]], pd.DataFrame(found, columns=STATS, index=pdf.index)], axis=1)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return written(rows.mapInPandas(run, f"id {kind}, " + ", ".join(f"{s} double" for s in STATS)), "stats")


@dataclass(frozen=True)
class TreeRule:
    """Bounds on statistics: (index, low, high), meaning low < value <= high."""

    bounds: tuple[tuple[int, float, float], ...]

    def column(self) -> Column:
        test = F.lit(True)
        for k, low, high in self.bounds:
            if low > -math.inf:
                test = test & (F.col(STATS[k]) > low)
            if high < math.inf:
                test = test & (F.col(STATS[k]) <= high)
        return test

    def text(self) -> str:
        return " and ".join(f"{low:g} < {STATS[k]} <= {high:g}" for k, low, high in self.bounds)


_NODE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_rules(debug_text: str) -> list[TreeRule]:
    """All paths of a printed tree, from the root to every node below it."""
    path: list[tuple[int, int, str, float]] = []
    rules = []
    for line in debug_text.splitlines():
        m = _NODE.match(line)
        if not m:
            continue
        depth = len(m[1])
        path = [x for x in path if x[0] < depth] + [(depth, int(m[3]), m[4], float(m[5]))]
        bounds: dict[int, list[float]] = {}
        for _, k, side, t in path:
            b = bounds.setdefault(k, [-math.inf, math.inf])
            if side == "<=":
                b[1] = min(b[1], t)
            else:
                b[0] = max(b[0], t)
        rules.append(TreeRule(tuple((k, *b) for k, b in sorted(bounds.items()))))
    return rules


@dataclass
class RuleEnsemble:
    """Weighted rules and clipped statistics, or a constant probability."""

    constant: float | None
    intercept: float = 0.0
    rules: tuple[tuple[TreeRule, float], ...] = ()
    linear: tuple[tuple[str, float, float, float], ...] = ()  # name, low, high, weight

    def score(self) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), weight).otherwise(0.0)
        for name, low, high, weight in self.linear:
            z = z + weight * clipped(name, low, high)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def clipped(name: str, low: float, high: float) -> Column:
    """A statistic held between two quantiles and brought to 0..1."""
    return (F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high)) - low) / (high - low)


def fit(labelled: DataFrame, trees: int = 24, depth: int = 3, penalty: float = 0.0005, seed: int = 17) -> RuleEnsemble:
    """Fit on rows (statistics, label) with label 0.0 or 1.0."""
    count, share = labelled.agg(F.count("*"), F.avg("label")).first()
    if not count or share in (0.0, 1.0):
        return RuleEnsemble(constant=0.5 if not count else float(share))
    vector = VectorAssembler(inputCols=list(STATS), outputCol="vector").transform(labelled)
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64,
                                    minInstancesPerNode=max(1, min(20, count // 50)), subsamplingRate=0.7,
                                    featureSubsetStrategy="0.4", seed=seed).fit(vector.select("vector", "label"))
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree.toDebugString)}, key=lambda r: r.bounds)
    quantiles = labelled.select([F.percentile_approx(s, F.array(F.lit(0.02), F.lit(0.98)), F.lit(1000)).alias(s) for s in STATS]).first()
    linear = [(s, *quantiles[s]) for s in STATS if quantiles[s][1] > quantiles[s][0]]
    terms = [r.column().cast("double").alias(f"r{k}") for k, r in enumerate(rules)]
    terms += [clipped(*x).alias(f"l{k}") for k, x in enumerate(linear)]
    names = [f"r{k}" for k in range(len(rules))] + [f"l{k}" for k in range(len(linear))]
    table = VectorAssembler(inputCols=names, outputCol="terms").transform(labelled.select("label", *terms))
    lasso = LogisticRegression(featuresCol="terms", labelCol="label", elasticNetParam=1.0, regParam=penalty,
                               maxIter=60, standardization=True).fit(table.select("terms", "label"))
    weights = [float(w) for w in lasso.coefficients.toArray()]
    return RuleEnsemble(None, float(lasso.intercept),
                        tuple((r, w) for r, w in zip(rules, weights) if w),
                        tuple((*x, w) for x, w in zip(linear, weights[len(rules):]) if w))


def rate_quality(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """(id, held_out, score): learned from labelled rows whose id's CRC-32 mod 4 is not 2."""
    tune(docs.sparkSession)
    stats = measure(docs, id_col, text_col)
    remainder = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    marks = marks.filter(F.col("label").isNotNull() & ~remainder(F.col("id")))
    labelled = written(stats.join(marks, "id").select("label", *STATS), "labelled")
    model = fit(labelled)
    return stats.select("id", remainder(F.col("id")).alias("held_out"), model.score().alias("score"))
