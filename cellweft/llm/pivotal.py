"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code point order (null last) weigh 3, 1, 2, repeating. Together they
take 1.5 times all words; a source's target stops at twice its own words and what
it leaves is shared out again by weight. Every document of a source should be
taken ``target / words`` times. The whole part is certain; the fractions are rounded in
pairs: a random transfer of words between two documents makes one of the two
fractions 0 or 1 and keeps the source's sum of words exactly. What is left open in
a block of documents goes up a tree of blocks to one open document per source, whose
fraction is drawn last, so a source misses its target by less than one document.

Blocks are made by a hash of the id, and equal rows are numbered and go to one block after the other, so
they hold about ``block_rows`` rows whatever the size of a source or the rows of one id; the tree has a fan-in of ``fan``. Draws depend on ids and the seed
only, so reruns agree.

Defined results: null or empty text has size 0 and takes 0. Rows that agree in id, source
and size are interchangeable; each is rounded by itself. A source without words has target 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from cellweft.llm.common import number_copies, small_side, tune, written

#: The weights, the share of all words, the limit per source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, n, target) from rows (source, size).

    Ranks come from a range sort with one count per range. The rounds that share out what
    capped sources leave are one-row aggregates; each caps at least one more kind of source or ends.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranges = written(totals.repartitionByRange(F.col("source").asc_nulls_last())
                     .withColumn("range", F.spark_partition_id()), "sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("range").agg(F.count("*").alias("k")).select(
        "range", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    ranked = ranges.withColumn("place", F.row_number().over(within) - 1).join(starts, "range")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("start") + F.col("place")) % len(weights) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", "n", weight.cast("double").alias("weight")), "weights")

    words = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = limit * F.col("source_size")
    level = 0.0
    while words:
        over = cap <= level * F.col("weight")
        fixed, free = ranked.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        new = (share * words - fixed) / free if free else level
        if new <= level or not free:
            break
        level = new
    return ranked.select("source", "source_size", "n", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def draw(seed: int, row_key: str, step: str) -> float:
    """A number in [0, 1) fixed by its arguments."""
    return xxhash.xxh64_intdigest(f"{step}|{row_key}", seed=seed) / 2.0**64


def settle(sizes, shares, keys, seed: int, step: str) -> tuple[np.ndarray, int | None]:
    """Round the fractions of one block; the index of the one left open, if any.

    Words move between the open document and the next one: up to what fills one of the two or
    empties the other. The odds keep every document's expected share.
    """
    shares = np.array(shares, float)
    held = None
    for i in range(len(shares)):
        if not 0.0 < shares[i] < 1.0:
            continue
        if held is None:
            held = i
            continue
        a, b = sizes[held], sizes[i]
        up = min((1.0 - shares[held]) * a, shares[i] * b)
        down = min(shares[held] * a, (1.0 - shares[i]) * b)
        if draw(seed, keys[i], step) * (up + down) < down:
            moved = up
        else:
            moved = -down
        first, second = shares[held] + moved / a, shares[i] - moved / b
        fill = abs(moved)
        whole_first = fill == ((1.0 - shares[held]) * a if moved > 0 else shares[held] * a)
        whole_second = fill == (shares[i] * b if moved > 0 else (1.0 - shares[i]) * b)
        shares[held] = (1.0 if moved > 0 else 0.0) if whole_first else first
        shares[i] = (0.0 if moved > 0 else 1.0) if whole_second else second
        held = i if 0.0 < shares[i] < 1.0 else held if 0.0 < shares[held] < 1.0 else None
    return shares, held


def round_blocks(rows: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    """Round every (source, block); ``open`` marks a row whose fraction goes on to the next level."""

    def run(key, pdf):
        pdf = pdf.sort_values(["size", "id"], ascending=[False, True], kind="stable", na_position="first").reset_index(drop=True)
        names = [f"{i}|{s}|{n}" for n, (i, s) in enumerate(zip(pdf["id"], pdf["size"]))]
        shares, held = settle(pdf["size"].to_numpy(float), pdf["share"], names, seed, f"{level}|{key[0]}|{key[1]}")
        if held is not None and last:
            shares[held] = float(draw(seed, names[held], "last") < shares[held])
            held = None
        pdf["share"] = shares
        pdf["open"] = np.arange(len(pdf)) == (-1 if held is None else held)
        return pdf

    return rows.groupBy("source", "block").applyInPandas(run, rows.schema)


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = 7,
                block_rows: int = 20_000, fan: int = 256) -> DataFrame:
    """(id, source, size, source_size, target, taken, copies), one row per document."""
    tune(docs.sparkSession)
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = written(sizes, "sizes")
    targets = small_side(source_targets(rows.select("source", "size")), "targets")
    largest = targets.agg(F.max("n")).first()[0] or 0
    rows = number_copies(rows, block_rows)
    told = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    times = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(LIMIT))).otherwise(0.0)
    blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.lit(1))
    told = told.withColumn("times", times)
    told = told.select("id", "source", "size", "source_size", "target", F.floor("times").cast("double").alias("whole"),
                       F.when(F.col("size") > 0, F.col("times") - F.floor("times")).otherwise(0.0).alias("share"),
                       F.pmod(F.pmod(F.xxhash64(F.lit(seed), "id"), blocks) + F.col("copy"), blocks).alias("block"), F.lit(False).alias("open"))
    levels = 1
    most = max(1, math.ceil(largest / block_rows))
    while most > 1:
        most, levels = math.ceil(most / fan), levels + 1
    done, waiting = None, told
    for level in range(levels):
        out = written(round_blocks(waiting, level, seed, level == levels - 1), "rounded")
        settled = out.filter(~F.col("open"))
        done = settled if done is None else done.unionByName(settled)
        waiting = out.filter("open").withColumns({"block": F.floor(F.col("block") / fan), "open": F.lit(False)})
    taken = ((F.col("whole") + F.col("share")) * F.col("size")).cast("long")
    return done.select("id", "source", "size", "source_size", "target", taken.alias("taken"),
                       (F.col("whole") + F.col("share")).cast("int").alias("copies"))


def repeat_rows(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = 7) -> DataFrame:
    """Every document as often as the mix takes it, with its own columns.

    Rows that agree in id, source and size share out their copies by row number.
    """
    names = docs.columns
    inner = {c: f"c{k}" for k, c in enumerate(names)}
    mixed = mix_sources(docs, id_col, text_col, source_col, seed)
    rows = docs.toDF(*inner.values()).withColumn("size", word_count(F.col(inner[text_col])))
    id_, source = inner[id_col], inner[source_col]
    taken = mixed.groupBy(F.col("id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size")).agg(
        F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    same = (F.col(id_).eqNullSafe(F.col("m_id")) & F.col(source).eqNullSafe(F.col("m_source"))
            & (F.col("size") == F.col("m_size")))
    told = rows.join(taken.filter("copies > 0").hint("shuffle_hash"), same)
    one = told.filter("rows = 1").select(*inner.values(), F.col("copies").cast("int").alias("times"))
    place = F.row_number().over(Window.partitionBy("m_id", "m_source", "m_size").orderBy(F.xxhash64(*inner.values())))
    share = F.floor(F.col("copies") / F.col("rows")) + (place <= F.col("copies") % F.col("rows")).cast("int")
    more = told.filter("rows > 1").select(*inner.values(), share.cast("int").alias("times"))
    both = one.unionByName(more).filter("times > 0")
    return both.select(*inner.values(), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("turn")).drop("turn").toDF(*names)
