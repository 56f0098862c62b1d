"""Exact character grams: modified Kneser-Ney of order four over UTF-16 code units, without folds.

A character up to U+FFFF is one unit, any other two, so four units are exactly 64 bits: the
predicted unit in the low 16, above it its predecessors. The low bits of a gram are its suffix
grams, all bits above the lowest 16 its context. Models have no fixed size: counts, continuation
counts, context totals and probabilities are Spark aggregates and joins over the distinct grams.

A document must not make its own oddities likely. A gram (of any order) that only one distinct text of
its language holds gives its whole count to the back-off, so that text pays for it as if unseen.
Below the lowest order stands one share for each of the 65,536 units.

``cost`` is -log p in steps of 1 / SCALE, rounded once a gram; sums of it are exact in any order.
Scans look up the at most HOT most frequent grams in a broadcast; the other ones of a document are joined by shuffle.

``tongue`` stands for a language, null included, in keys that are never null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cellweft.llm.common import small_side, written

UNIT = 16
ORDER = 4
HOT = 1 << 21
SCALE = 1 << 24
#: What a gram costs that the model never met: p = 1e-12.
FLOOR = round(-math.log(1e-12) * SCALE)


def tongue_of(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def exact_grams(text: str) -> np.ndarray:
    """Gram of every unit with its three predecessors; before the text stand newlines."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    c = np.concatenate([[10] * (ORDER - 1), units]).astype(np.int64)
    gram = c[ORDER - 1:].copy()
    for k in range(1, ORDER):
        gram |= c[ORDER - 1 - k:len(c) - k] << (UNIT * k)
    return gram


def add_up(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(gram, n, first, last) of some texts: count, smallest and largest hash of a text that holds the gram."""
    parts = [np.unique(exact_grams(text), return_counts=True) for text in texts]
    marks = np.fromiter((xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) for text in texts), np.uint64, len(texts))
    grams, n = (np.concatenate(part) for part in zip(*parts))
    mark = np.repeat(marks.view(np.int64), [len(seen) for seen, _ in parts])
    order = np.argsort(grams, kind="stable")
    grams, mark = grams[order], mark[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[starts], np.add.reduceat(n[order], starts), np.minimum.reduceat(mark, starts), np.maximum.reduceat(mark, starts)


def count_exact(docs: DataFrame) -> DataFrame:
    """(tongue, gram, n, first, last) over rows (text, lang); a written copy."""

    def tally(batches):
        for pdf in batches:
            own: dict[str | None, list[str]] = {}
            for text, lang in zip(pdf["text"], pdf["lang"]):
                if text:
                    own.setdefault(lang, []).append(text)
            for lang, texts in own.items():
                found = add_up(texts)
                for start in range(0, len(found[0]), 100_000):
                    part = [a[start:start + 100_000] for a in found]
                    yield pd.DataFrame({"lang": pd.Series([lang] * len(part[0]), dtype=object),
                                        **dict(zip(("gram", "n", "first", "last"), part))})

    rows = docs.select("text", "lang").mapInPandas(tally, "lang string, gram long, n long, first long, last long")
    return written(rows.groupBy(tongue_of(F.col("lang")).alias("tongue"), "gram").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")), "grams")


def lower_order(rows: DataFrame, order: int) -> DataFrame:
    """Grams of ``order`` from the distinct ones of the order above, whose number is their count; a written copy."""
    return written(rows.groupBy("tongue", F.col("gram").bitwiseAND((1 << UNIT * order) - 1).alias("gram")).agg(
        F.count("*").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")), "grams")


def with_shares(rows: DataFrame) -> DataFrame:
    """(tongue, gram, n, share, weight): the discounted share of a gram and the back-off weight of its context."""
    n = F.col("n")
    tally = rows.groupBy("tongue").agg(*[F.count_if(n == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    raw = [F.when(F.col(f"n{k}") > 0, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(y * k) for k in (1, 2, 3)]
    bounded = [F.least(F.greatest(d, F.lit(0.05 * k)), F.lit(0.95 * k)).alias(f"d{k}") for k, d in zip((1, 2, 3), raw)]
    discounts = small_side(tally.select("tongue", *bounded), "discounts")
    own = F.col("first") == F.col("last")
    context = F.shiftrightunsigned("gram", UNIT)
    totals = rows.groupBy("tongue", context.alias("context")).agg(
        F.sum("n").alias("total"), F.sum(F.when(own, n).otherwise(0)).alias("given"),
        *[F.count_if(~own & (n >= 3 if k == 3 else n == k)).alias(f"a{k}") for k in (1, 2, 3)])
    held = F.col("given") + sum(F.col(f"a{k}") * F.col(f"d{k}") for k in (1, 2, 3))
    contexts = totals.join(discounts, "tongue").select("tongue", "context", "total", "d1", "d2", "d3", (held / F.col("total")).alias("weight"))
    left = n - F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    told = rows.withColumn("context", context).join(contexts, ["tongue", "context"])
    return told.select("tongue", "gram", "n", F.when(own, 0.0).otherwise(left / F.col("total")).alias("share"), "weight")


def exact_costs(docs: DataFrame) -> DataFrame:
    """(tongue, gram, n, cost) of every distinct gram of the rows (text, lang); a written copy."""
    orders = [count_exact(docs)]
    for order in range(ORDER - 1, 0, -1):
        orders.append(lower_order(orders[-1], order))
    p = F.col("share") + F.col("weight") / (1 << UNIT)
    known = with_shares(orders.pop()).select("tongue", "gram", "n", p.alias("p"))
    for order in range(1, ORDER):
        below = known.select("tongue", F.col("gram").alias("suffix"), F.col("p").alias("back"))
        rows = with_shares(orders.pop()).withColumn("suffix", F.col("gram").bitwiseAND((1 << UNIT * order) - 1))
        p = F.col("share") + F.col("weight") * F.col("back")
        known = written(rows.join(below, ["tongue", "suffix"]).select("tongue", "gram", "n", p.alias("p")), "shares")
    return known.select("tongue", "gram", "n", F.round(-F.log("p") * SCALE).cast("int").alias("cost"))


def hot_and_rare(costs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent grams, at most HOT, and the others, if any: cut at a power of two of their count."""
    level = F.floor(F.log2("n")).cast("int")
    # At most 64 short rows.
    sizes = {r["level"]: r["count"] for r in costs.groupBy(level.alias("level")).count().collect()}
    least, seen = max(sizes, default=0) + 1, 0
    while least > 0 and seen + sizes.get(least - 1, 0) <= HOT:
        least -= 1
        seen += sizes.get(least, 0)
    return (costs, None) if least == 0 else (costs.filter(level >= least), costs.filter(level < least))


def gathered(hot: DataFrame) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and their costs by language."""
    rows = hot.select("tongue", "gram", "cost").toArrow()
    tongues = rows["tongue"].combine_chunks().dictionary_encode()
    codes, grams, costs = tongues.indices.to_numpy(zero_copy_only=False), rows["gram"].to_numpy(), rows["cost"].to_numpy()
    order = np.lexsort((grams, codes))
    ends = np.searchsorted(codes[order], np.arange(len(tongues.dictionary) + 1))
    names = [name[1:] if name else None for name in tongues.dictionary.to_pylist()]
    return {name: (grams[order[a:b]], costs[order[a:b]]) for name, a, b in zip(names, ends, ends[1:])}


def cost_of(text: str | None, known: tuple[np.ndarray, np.ndarray] | None) -> tuple[int | None, np.ndarray, np.ndarray]:
    """Cost of the grams that are known, and the others with their counts; no cost without text."""
    none = np.empty(0, np.int64)
    if not text:
        return None, none, none
    seen, n = np.unique(exact_grams(text), return_counts=True)
    if known is None:
        return 0, seen, n
    at = np.minimum(np.searchsorted(known[0], seen), len(known[0]) - 1)
    hit = known[0][at] == seen
    return int((n * np.where(hit, known[1][at], 0)).sum()), seen[~hit], n[~hit]


def settle(measured: DataFrame, rare: DataFrame, lang_col: str) -> DataFrame:
    """``measured`` with the costs of its ``rare_grams`` added to ``cost``; rows are told apart by ``row``."""
    pairs = measured.select("row", tongue_of(F.col(f"`{lang_col}`")).alias("tongue"),
                            F.explode(F.arrays_zip("rare_grams", "rare_n")).alias("pair"))
    pairs = pairs.select("row", "tongue", F.col("pair.rare_grams").alias("gram"), F.col("pair.rare_n").alias("times"))
    paid = pairs.join(rare.select("tongue", "gram", F.col("cost").alias("each")), ["tongue", "gram"], "left")
    more = paid.groupBy("row").agg(F.sum(F.col("times") * F.coalesce("each", F.lit(FLOOR))).alias("more"))
    joined = measured.drop("rare_grams", "rare_n").join(more, "row", "left")
    return joined.withColumn("cost", F.col("cost") + F.coalesce("more", F.lit(0))).drop("row", "more")
