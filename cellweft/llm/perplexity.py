"""Quality rules: plain counts, and character n-gram perplexity by language.

Two models judge a text: one of exact grams (``exact_grams``: every code unit as it stands, models of any
size, ``exact_loss``), and one of folded characters, described here (``loss``), which tells how
the text is built even where its exact grams are rare. A text must lie inside the bands of both.

The folded model is modified Kneser-Ney of order four over characters. A
character folds the more the further it stands from the predicted one: 7 bits for
the predicted character, then 6, 5 and 3. The low bits of a gram are then its own
suffix gram, and all bits above the lowest 7 are its context, so Kneser-Ney's
continuation counts come straight from the distinct grams of the order above.
Every distinct language has a model of its own, of at most 2**21 grams.

Spark counts the grams of all documents (each task adds up first). Each model is
built by one task from its at most 2**21 counts, and is written as sorted arrays of
gram hashes with their discounted shares, and of contexts with their back-off weights.

Languages are scored in rounds: a round gathers and broadcasts models of at most 2**24
grams, and scans the documents once. So seven languages of full size, or about 3,500 small ones, take
one scan, and more languages take more scans, not more memory. A worker holds dense tables of
the DENSE largest models of a round; the others are looked up in their sorted arrays.

Bands: per language, documents that pass the plain rules form a histogram of
log-perplexity per word. The band reaches ``width`` times the distance from the median to the
10 % and 90 % quantiles, at least ``least`` to either side; a document outside either
model's band is rejected. A null language is a language of its own.

Defined results: a null or empty text has no words, all counts 0 and no perplexity, and
fails the plain rules. Repeated rows are counted and judged each time.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cellweft.llm import exact_grams as exact
from cellweft.llm.common import small_side, tune, written
from cellweft.llm.words import hash_words, split_words, windows

BITS = (7, 6, 5, 3)
SUFFIX_BITS = (7, 13, 18, 21)
GRAMS = 1 << SUFFIX_BITS[-1]
ROUND_GRAMS = 1 << 24
#: What a model counts in a round besides its grams.
MODEL_COST = 1 << 12
DENSE = 8
BIN = 0.02
BINS = 4000


def _fold_tables() -> tuple[np.ndarray, ...]:
    """Character class by distance: 128, 64, 32 and 8 classes of a code point below 1024."""
    seven = np.arange(1024)
    free = np.array([c for c in range(1, 32) if c not in range(9, 14)])
    seven[128:] = free[seven[128:] % len(free)]
    six = np.empty(1024, np.int64)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    for c in range(1024):
        if 97 <= c <= 122:
            six[c] = c - 97
        elif 65 <= c <= 90:
            six[c] = 26 + (c - 65) // 3
        elif 48 <= c <= 57:
            six[c] = 35
        elif c == 32:
            six[c] = 36
        elif 9 <= c <= 13:
            six[c] = 37
        elif c in marks:
            six[c] = 38 + marks.index(c) % 16
        else:
            six[c] = 54 + c % 10
    return seven, six, six >> 1, six >> 3


FOLDS = _fold_tables()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams_of(points: np.ndarray) -> np.ndarray:
    """Gram of every character with its three predecessors; before the text stand newlines."""
    c = np.where(points < 1024, points, 128 + points % 896).astype(np.int64)
    c = np.concatenate([[10, 10, 10], c])
    n = len(points)
    gram = FOLDS[0][c[3:]]
    for k in (1, 2, 3):
        gram = gram | (FOLDS[k][c[3 - k:3 - k + n]] << SUFFIX_BITS[k - 1])
    return gram


def by_lang(texts, langs) -> dict[str | None, list[int]]:
    """Positions of the texts that are neither null nor empty, by language."""
    found: dict[str | None, list[int]] = {}
    for at, (text, lang) in enumerate(zip(texts, langs)):
        if text:
            found.setdefault(lang, []).append(at)
    return found


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over rows (text, lang)."""

    def rows_of(lang, seen, n):
        for start in range(0, len(seen), 100_000):
            part = slice(start, start + 100_000)
            yield pd.DataFrame({"lang": pd.Series([lang] * len(seen[part]), dtype=object), "gram": seen[part], "n": n[part]})

    def tally(batches):
        totals: dict[str | None, np.ndarray] = {}
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lang, places in by_lang(texts, pdf["lang"]).items():
                if lang not in totals and len(totals) < DENSE:
                    totals[lang] = np.zeros(GRAMS, np.int64)
                if lang in totals:
                    for at in places:
                        seen, n = np.unique(grams_of(code_points(texts[at])), return_counts=True)
                        totals[lang][seen] += n
                else:  # beyond DENSE languages a task adds up by batch only
                    grams = np.concatenate([grams_of(code_points(texts[at])) for at in places])
                    yield from rows_of(lang, *np.unique(grams, return_counts=True))
        for lang, counts in totals.items():
            seen = np.flatnonzero(counts)
            yield from rows_of(lang, seen, counts[seen])

    rows = docs.select("text", "lang").mapInPandas(tally, "lang string, gram int, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more."""
    n = [float((counts == k).sum()) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    found = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else y * k
        found.append(min(max(d, 0.05 * k), 0.95 * k))
    return np.array(found)


def build_order(grams: np.ndarray, counts: np.ndarray):
    """Sorted (grams, shares) and (contexts, back-off weights) of one order."""
    d = discounts(counts)[np.minimum(counts, 3)]
    contexts, inverse = np.unique(grams >> BITS[0], return_inverse=True)
    totals = np.bincount(inverse, counts)
    return grams, ((counts - d) / totals[inverse]).astype(np.float32), contexts, (np.bincount(inverse, d) / totals).astype(np.float32)


def build_model(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Orders 1 to 4; below the highest, a count is the number of distinct grams with that suffix."""
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    built = [build_order(grams, counts)]
    for bits in SUFFIX_BITS[-2::-1]:
        grams, counts = np.unique(grams & ((1 << bits) - 1), return_counts=True)
        built.append(build_order(grams, counts))
    return built[::-1]


def log_table(orders) -> np.ndarray:
    """log p of every gram: shares plus back-off weight times the next lower order."""
    p = np.full(1, 1.0 / (1 << BITS[0]), np.float32)
    for bits, (grams, shares, contexts, weights) in zip(SUFFIX_BITS, orders):
        every = np.arange(1 << bits)
        back = np.ones(1 << (bits - BITS[0]), np.float32)
        back[contexts] = weights
        p = back[every >> BITS[0]] * (p[every & (len(p) - 1)] if len(p) > 1 else p[0])
        p[grams] += shares
    return np.log(np.maximum(p, 1e-12), dtype=np.float32)


def log_lookup(orders, grams: np.ndarray) -> np.ndarray:
    """log p of the given grams, as ``log_table`` has them, from the sorted arrays alone."""
    p = np.full(len(grams), 1.0 / (1 << BITS[0]), np.float32)
    for bits, (known, shares, contexts, weights) in zip(SUFFIX_BITS, orders):
        gram = grams & ((1 << bits) - 1)
        for keys, values, wanted, put in ((contexts, weights, gram >> BITS[0], np.multiply), (known, shares, gram, np.add)):
            at = np.minimum(np.searchsorted(keys, wanted.astype(keys.dtype)), len(keys) - 1)
            put(p, values[at], out=p, where=keys[at] == wanted)
    return np.log(np.maximum(p, 1e-12), dtype=np.float32)


def train(docs: DataFrame) -> DataFrame:
    """(lang, rank, grams, shares, contexts, weights, size): a written row for every order of every model."""

    def build(key, pdf):
        rows = []
        for order, arrays in enumerate(build_model(pdf["gram"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64))):
            kinds = (np.int32, np.float32, np.int32, np.float32)
            rows.append((key[0], order, *[a.astype(k).tobytes() for a, k in zip(arrays, kinds)], len(pdf)))
        return pd.DataFrame(rows, columns=["lang", "rank", "grams", "shares", "contexts", "weights", "size"])

    return written(count_grams(docs).groupBy("lang").applyInPandas(
        build, "lang string, rank int, grams binary, shares binary, contexts binary, weights binary, size int"), "models")


def rounds_of(models: DataFrame) -> DataFrame:
    """(model_lang, round): languages whose models together have at most ROUND_GRAMS grams share a round."""
    # One short row per language, whatever the number of documents.
    before = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)
    least = ROUND_GRAMS - GRAMS - MODEL_COST  # a round ends at most one model later
    started = F.coalesce(F.sum(F.col("size") + MODEL_COST).over(before), F.lit(0))
    return models.filter("rank = 0").select(F.col("lang").alias("model_lang"), F.floor(started / least).cast("int").alias("round"))


def gathered(models: DataFrame) -> dict[str | None, list]:
    """Sorted arrays of the models of one round, the largest first."""
    found: dict[str | None, list] = {}
    for row in sorted(models.collect(), key=lambda r: (-r["size"], r["lang"] is not None, r["lang"] or "", r["rank"])):
        found.setdefault(row["lang"], []).append(
            (np.frombuffer(row["grams"], np.int32), np.frombuffer(row["shares"], np.float32),
             np.frombuffer(row["contexts"], np.int32), np.frombuffer(row["weights"], np.float32)))
    return found


_TABLES: dict[tuple[str, str | None], np.ndarray] = {}


def table_of(name: str, models: dict[str | None, list], lang: str | None) -> np.ndarray:
    """The dense table of a model of the set called ``name``, made once per worker process."""
    key = (name, lang)
    if key not in _TABLES:
        if any(k[0] != name for k in _TABLES):
            _TABLES.clear()
        _TABLES[key] = log_table(models[lang])
    return _TABLES[key]


SYMBOLS = np.zeros(128, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
SPACES = np.zeros(128, bool)
SPACES[[32, *range(9, 14)]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    points = code_points(text)
    low = points[points < 128]
    words = split_words(text)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    repeated = 0
    if len(words) > 3:
        grams = windows(hash_words(words), 3)
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(grams), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(words), bool)
        for j in range(3):
            covered[j:j + len(grams)] |= twice
        repeated = int(covered.sum())
    return (len(words), len(points) - int(SPACES[low].sum()), int(SYMBOLS[low].sum()),
            len(lines) - len(set(lines)), repeated)


def total_loss(text: str | None, table: np.ndarray | None, orders: list | None = None) -> float:
    """Negative log-probability of a text by a dense table or else sorted arrays; not a number without text or model."""
    if not text or (table is None and orders is None):
        return np.nan
    grams = grams_of(code_points(text))
    if table is not None:
        return -float(table[grams].sum(dtype=np.float64))
    seen, inverse = np.unique(grams, return_inverse=True)
    return -float(log_lookup(orders, seen)[inverse].sum(dtype=np.float64))


def measure(docs: DataFrame, models: DataFrame, costs: DataFrame, text_col="text", lang_col="lang", keep_text=False) -> DataFrame:
    """A written copy of the given columns (the text if asked for), with those of COUNTS, ``loss``, ``exact_loss`` and ``base_failed``."""
    hot, rare = exact.hot_and_rare(costs)
    known = docs.sparkSession.sparkContext.broadcast(exact.gathered(hot))
    rounds = written(rounds_of(models), "rounds")
    last = rounds.agg(F.max("round")).first()[0] or 0
    placed, told = docs, models.withColumn("round", F.lit(0))
    if last:
        side = small_side(rounds, "rounds")
        names = [F.col(f"`{c}`") for c in docs.columns]
        joined = docs.join(side, F.col(f"`{lang_col}`").eqNullSafe(F.col("model_lang")), "left")
        placed = joined.withColumn("round", F.coalesce("round", F.lit(0)))
        told = models.join(side, F.col("lang").eqNullSafe(F.col("model_lang")))
    out = None
    for k in range(last + 1):
        rows = placed.filter(F.col("round") == k).select(*names) if last else placed
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, gathered(told.filter(F.col("round") == k))))
        part = written(measure_round(rows, shared, known, rare is not None, text_col, lang_col, keep_text), "measured")
        shared.destroy()
        if rare is not None:
            part = written(exact.settle(part, rare, lang_col), "measured")
        out = part if out is None else out.unionByName(part)
    known.destroy()
    exact_loss = F.col("cost") / exact.SCALE / F.greatest("n_words", F.lit(1))
    return out.withColumn("exact_loss", exact_loss).drop("cost")


def measure_round(docs: DataFrame, shared, known, some_rare: bool, text_col: str, lang_col: str, keep_text: bool) -> DataFrame:
    """``measure`` for documents whose languages' models are in ``shared``, a broadcast (name, models).

    ``cost`` adds up the exact grams in the broadcast ``known``. The others of a row stay beside it if ``some_rare``, or cost FLOOR.
    """

    def run(batches):
        name, models = shared.value
        dense = set(list(models)[:DENSE])
        for pdf in batches:
            counts = [plain_counts(text) for text in pdf[text_col]]
            losses = [total_loss(text, table_of(name, models, lang) if lang in dense else None, models.get(lang))
                      for text, lang in zip(pdf[text_col], pdf[lang_col])]
            out = pdf if keep_text else pdf.drop(columns=[text_col])
            for column, values in zip(COUNTS, zip(*counts) if counts else [[]] * 5):
                out[column] = np.array(values, np.int64)
            out["loss"] = np.array(losses, np.float64) / np.maximum(out["n_words"], 1)
            paid = [exact.cost_of(text, known.value.get(lang)) for text, lang in zip(pdf[text_col], pdf[lang_col])]
            if some_rare:
                out["cost"] = pd.array([cost for cost, _, _ in paid], "Int64")
                out["rare_grams"], out["rare_n"] = [[p[k] for p in paid] for k in (1, 2)]
            else:
                out["cost"] = pd.array([cost if cost is None else cost + exact.FLOOR * int(n.sum()) for cost, _, n in paid], "Int64")
            yield out

    kept = [f"`{name}` {kind}" for name, kind in docs.dtypes if keep_text or name != text_col]
    rare = ["rare_grams array<long>", "rare_n array<long>"] if some_rare else []
    counted = docs.mapInPandas(run, ", ".join([*kept, *[f"{c} long" for c in COUNTS], "loss double", "cost long", *rare]))
    if some_rare:
        counted = counted.withColumn("row", F.monotonically_increasing_id())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumns({"base_failed": failed, "loss": F.when(~F.isnan("loss"), F.col("loss"))})


def bin_of(loss):
    """BINS bins of BIN, and above them bins that grow with the loss, 1 / BINS of it each."""
    top = BIN * BINS
    return F.when(loss < top, F.floor(loss / BIN)).otherwise(F.floor(BINS * (1 + F.log(loss / top))))


def start_of(bin_):
    return F.when(bin_ <= BINS, bin_ * BIN).otherwise(BIN * BINS * F.exp(bin_ / BINS - 1))


def bands(measured: DataFrame, width: float = 6.0, least: float = 1.0, lang_col="lang", loss_col="loss") -> DataFrame:
    """(lang, low, high) of log-perplexity per word, from a histogram.

    Its rows a language grow with the logarithm of the largest loss: a text of 2**31
    characters in 50 words falls into bin 70,049.
    """
    passed = measured.filter(~F.col("base_failed") & F.col(loss_col).isNotNull())
    histogram = passed.groupBy(F.col(lang_col).alias("lang"), bin_of(F.col(loss_col)).alias("bin")).count()
    quantiles = F.percentile(start_of(F.col("bin")), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), F.col("count"))
    q = histogram.groupBy("lang").agg(quantiles.alias("q"))
    low, middle, high = (F.col("q")[i] for i in range(3))
    return q.select(F.col("lang").alias("band_lang"),
                    (middle - F.greatest(F.lit(least), width * (middle - low))).alias("low"),
                    (middle + F.greatest(F.lit(least), width * (high - middle))).alias("high"))


def judge(measured: DataFrame, width: float = 6.0, least: float = 1.0, lang_col="lang") -> DataFrame:
    """``measured`` with ``kept``: passes the plain rules and lies inside its language's band of either loss."""
    told = measured.withColumn("kept", ~F.col("base_failed"))
    for loss in ("loss", "exact_loss"):
        limits = small_side(bands(measured, width, least, lang_col, loss), "bands")
        told = told.join(limits, F.col(lang_col).eqNullSafe(F.col("band_lang")), "left")
        inside = F.coalesce((F.col(loss) >= F.col("low")) & (F.col(loss) <= F.col("high")), F.lit(True))
        told = told.withColumn("kept", F.col("kept") & inside).drop("band_lang", "low", "high")
    return told


def rate_documents(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """(id, lang, counts, base_failed, loss, exact_loss, kept), one row per document."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return judge(measure(rows, train(rows), exact.exact_costs(rows)))


def keep_good(docs: DataFrame, text_col="text", lang_col="lang") -> DataFrame:
    """The documents that pass the plain rules and the bands, with their own columns."""
    tune(docs.sparkSession)
    names = docs.columns
    inner = {c: f"c{k}" for k, c in enumerate(names)}
    rows = docs.toDF(*inner.values())
    text, lang = inner[text_col], inner[lang_col]
    taught = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    measured = measure(rows, train(taught), exact.exact_costs(taught), text, lang, keep_text=True)
    return judge(measured, lang_col=lang).filter("kept").select(*inner.values()).toDF(*names)
