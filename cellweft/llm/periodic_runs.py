"""Stretches of words that repeat with a period, found by block convolution.

A text is cut into blocks of 8, 16, 32, ... words. An exact integer transform (modulo primes) gives, for
every block, the sum of squared differences to each place of the window that follows it; a sum of zero
is another occurrence of the block. The distance between the two is a seed: both places are extended
while words that far apart agree.

Why no run is missed: a run of smallest period q and length L >= max(24, 3q) holds a whole block of
B words together with its copy q words on, for B = 8 where q < 16 (L >= 2B - 1 + q) and else for the B
with B <= q < 2B (L >= 3q >= 2B + q). A stretch found for a multiple of q is the same stretch, so the
smallest distance of a stretch is its period.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cellweft.llm.common import fields, tune
from cellweft.llm.words import split_words

MIN_LENGTH = 24
MIN_REPEATS = 3
FIRST_BLOCK = 8
#: Primes with long power-of-two subgroups; 3 generates all three. Sums below their product are exact.
PRIMES = (469762049, 167772161, 998244353)
GENERATOR = 3
#: Numbers in one matrix of transforms.
MATRIX = 1 << 19


# Exact convolution ----------------------------------------------------------------------


@lru_cache(maxsize=512)
def _few_powers(base: int, many: int, prime: int) -> np.ndarray:
    return _all_powers(base, many, prime)


def _powers(base: int, many: int, prime: int) -> np.ndarray:
    """base ** 0 .. base ** (many - 1); short rows are kept for the next batch."""
    return (_few_powers if many <= 4096 else _all_powers)(base, many, prime)


def _all_powers(base: int, many: int, prime: int) -> np.ndarray:
    out = np.ones(max(many, 1), np.int64)
    done = 1
    while done < many:
        step = min(done, many - done)
        out[done:done + step] = out[:step] * pow(base, done, prime) % prime
        done += step
    return out


def _forward(rows: np.ndarray, prime: int) -> np.ndarray:
    """Transform of every row; the result is in bit-reversed order."""
    many, size = rows.shape
    width = size
    while width > 1:
        half = width // 2
        pairs = rows.reshape(many, size // width, 2, half)
        first, second = pairs[:, :, 0, :], pairs[:, :, 1, :]
        turned = (first - second + prime) * _powers(pow(GENERATOR, (prime - 1) // width, prime), half, prime) % prime
        total = first + second
        total -= prime * (total >= prime)
        pairs[:, :, 0, :], pairs[:, :, 1, :] = total, turned
        width = half
    return rows


def _backward(rows: np.ndarray, prime: int) -> np.ndarray:
    """Inverse of ``_forward``, but for the factor size."""
    many, size = rows.shape
    width = 2
    while width <= size:
        half = width // 2
        pairs = rows.reshape(many, size // width, 2, half)
        turn = _powers(pow(pow(GENERATOR, (prime - 1) // width, prime), prime - 2, prime), half, prime)
        second = pairs[:, :, 1, :] * turn % prime
        first = pairs[:, :, 0, :].copy()
        total = first + second
        pairs[:, :, 0, :] = total - prime * (total >= prime)
        less = first - second
        pairs[:, :, 1, :] = less + prime * (less < 0)
        width *= 2
    return rows


def squared_differences(blocks: np.ndarray, windows: np.ndarray, lags: int, prime: int) -> np.ndarray:
    """Sum over j of (block[j] - window[lag + j])**2 modulo ``prime``, for each row and lag below ``lags``.

    Numbers are not negative; windows are at least lags + block - 1 wide, a power of two.
    """
    many, block = blocks.shape
    size = windows.shape[1]
    x, y = blocks % prime, windows % prime
    squares = np.zeros((many, size + 1), np.int64)
    np.cumsum(y * y % prime, axis=1, out=squares[:, 1:])
    own = (x * x % prime).sum(axis=1)[:, None]
    turned = np.zeros((many, size), np.int64)
    turned[:, 0] = x[:, 0]
    turned[:, size - block + 1:] = x[:, :0:-1]
    product = _backward(_forward(turned, prime) * _forward(y.copy(), prime) % prime, prime)[:, :lags]
    cross = product * pow(size, prime - 2, prime) % prime
    return (own + squares[:, block:block + lags] - squares[:, :lags] - 2 * cross) % prime


def block_matches(numbers: np.ndarray, starts: np.ndarray, bound: np.ndarray, block: int, first: int, lags: int,
                  size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of every zero-mismatch occurrence at distances first .. first + lags - 1.

    ``bound`` is above the largest number of the block's text. Where block * bound**2 passes the primes used so
    far, zeros are tried again with the next prime: then they are zeros of the integers.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    padded = np.concatenate([numbers, np.zeros(first + size, np.int64)])
    step = max(MATRIX // size, 1)
    for at in range(0, len(starts), step):
        rows, limits = starts[at:at + step], bound[at:at + step].astype(np.float64) ** 2 * block
        zero = None
        product = 1.0
        for prime in PRIMES:
            left = np.arange(len(rows)) if zero is None else np.flatnonzero(zero.any(axis=1) & (limits >= product))
            if len(left):
                near = rows[left][:, None]
                sums = squared_differences(padded[near + np.arange(block)], padded[near + first + np.arange(size)], lags, prime)
                if zero is None:
                    zero = sums == 0
                else:
                    zero[left] &= sums == 0
            product *= prime
        row, lag = np.nonzero(zero)
        found.append((rows[row], lag + first))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


# Seeds to runs --------------------------------------------------------------------------


class _Prefixes:
    """Prefix sums of the words times powers of a base, modulo two primes: equal stretches have equal sums."""

    def __init__(self, codes: np.ndarray):
        self.parts = []
        for prime in PRIMES[:2]:
            power = _powers(1_000_003 % prime, len(codes) + 1, prime)
            sums = np.zeros(len(codes) + 1, np.int64)
            np.cumsum((codes + 1) * power[:-1] % prime, out=sums[1:])
            self.parts.append((prime, power, sums % prime))

    def equal(self, left: np.ndarray, distance: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.ones(len(left), bool)
        for prime, power, sums in self.parts:
            here = (sums[left + length] - sums[left]) % prime * power[distance] % prime
            right = left + distance
            out &= here == (sums[right + length] - sums[right]) % prime
        return out


def _extend(codes: np.ndarray, prefixes: _Prefixes, edge: np.ndarray, limit: np.ndarray, distance: np.ndarray,
            way: int) -> np.ndarray:
    """How many further words from ``edge`` agree with those ``distance`` on, up to ``limit``; ``way`` is 1 or -1.

    A few words are compared one by one. Where all agree, the rest is found by halving on prefix sums, so long
    stretches cost no more than short ones; ``find_runs`` compares the words of what becomes a run.
    """
    steps = np.arange(16)
    inside = steps < limit[:, None]
    here = np.where(inside, edge[:, None] + way * steps, 0)
    same = inside & (codes[here] == codes[np.where(inside, here + distance[:, None], 0)])
    gained = np.where(same.all(axis=1), len(steps), np.argmin(same, axis=1)).astype(np.int64)
    far = np.flatnonzero(gained == len(steps))
    low, high = gained[far], limit[far]
    while (low < high).any():
        middle = (low + high + 1) // 2
        left = edge[far] if way > 0 else edge[far] - middle + 1
        equal = prefixes.equal(left, distance[far], middle)
        low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
    gained[far] = low
    return gained


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for t in texts for w in t]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(flat) < MIN_LENGTH:
        return runs
    codes = pd.factorize(flat)[0].astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    # A word of a run stands in its text three times at least. Others get one number that no block holds.
    pairs, inverse, many = np.unique(owner * (int(codes.max()) + 1) + codes, return_inverse=True, return_counts=True)
    often = many >= MIN_REPEATS
    text_of_pair = pairs // (int(codes.max()) + 1)
    rank = np.cumsum(often)
    base = np.concatenate([[0], rank])[np.searchsorted(text_of_pair, np.arange(len(texts)))]
    kinds = np.bincount(text_of_pair[often], minlength=len(texts))
    numbers = np.where(often[inverse], rank[inverse] - 1 - base[owner], kinds[owner])
    rare = np.concatenate([[0], np.cumsum(~often[inverse])])
    stretches = []
    prefixes = _Prefixes(codes)
    block = FIRST_BLOCK
    while True:
        lowest = 1 if block == FIRST_BLOCK else block
        lags = 2 * block - lowest
        fits = np.flatnonzero(sizes >= max(MIN_LENGTH, MIN_REPEATS * lowest))
        if not len(fits):
            break
        counts = (sizes[fits] - lowest) // block
        starts = np.repeat(begins[fits], counts) + block * _count_up(counts)
        text = np.repeat(fits, counts)
        clean = rare[starts + block] == rare[starts]
        starts, text = starts[clean], text[clean]
        size = 1 << (block + lags - 2).bit_length()
        at, distance = block_matches(numbers, starts, kinds[text] + 1, block, lowest, lags, size)
        inside = at + distance + block <= ends[owner[at]]
        stretches.append(_chains(codes, prefixes, at[inside], distance[inside], block, begins, ends, owner))
        block *= 2
    start, length, period = (np.concatenate(part) for part in zip(*stretches))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    for i in np.lexsort((period, start)).tolist():
        j = int(owner[start[i]])
        stretch = codes[start[i]:start[i] + length[i]]
        if not np.array_equal(stretch[period[i]:], stretch[:-period[i]]):
            raise ArithmeticError("two stretches of words share their prefix sums")
        runs[j].append((int(start[i] - begins[j]), int(length[i]), int(period[i])))
    return runs


def _count_up(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _chains(codes: np.ndarray, prefixes: _Prefixes, at: np.ndarray, distance: np.ndarray, block: int, begins: np.ndarray,
            ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of one distance in neighbouring blocks are one chain; only its two ends are extended."""
    order = np.lexsort((at, distance))
    at, distance = at[order], distance[order]
    text = owner[at]
    opens = np.ones(len(at), bool)
    opens[1:] = (distance[1:] != distance[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + block)
    closes = np.roll(opens, -1)
    closes[-1:] = True
    low, high, distance, text = at[opens], at[closes] + block, distance[opens], text[opens]
    high = high + _extend(codes, prefixes, high, ends[text] - distance - high, distance, 1)
    low = low - _extend(codes, prefixes, low - 1, low - begins[text], distance, -1)
    length = high + distance - low
    good = length >= np.maximum(MIN_LENGTH, MIN_REPEATS * distance)
    return low[good], length[good], distance[good]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


# Spark ----------------------------------------------------------------------------------


def periodic_runs(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_words, runs (array of start, length, period), best (one of them or null), collapsed (text).

    Words are runs of characters other than space and U+0009 to U+000D. Nothing is shuffled: a row is judged alone.
    A null or empty text has no words, no run and an empty collapsed text. Repeated rows are judged alike, a null id is kept,
    other columns are left out, whatever their names. An empty table gives an empty one. The work on a text of n words is
    about n * log(n)**2, in matrices of ``MATRIX`` numbers; its memory is a few numbers per word. Of equal stretches only
    the one of the smallest period is a run; runs may overlap.
    """
    tune(documents.sparkSession)
    names = ("start", "length", "period")
    schema = fields(id=documents.schema[id].dataType.simpleString(), n_words="bigint", best="array<bigint>", collapsed="string",
                    **{f"{n}s": "array<bigint>" for n in names})

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [split_words(t) for t in pdf["text"]]
            found = find_runs(texts)
            rows = {"id": pdf["id"], "n_words": [len(t) for t in texts], "best": [strongest(r) for r in found],
                    "collapsed": [b" ".join(collapse(t, r)).decode("utf-8", "surrogatepass") for t, r in zip(texts, found)]}
            for k, name in enumerate(names):
                rows[f"{name}s"] = [[r[k] for r in runs] for runs in found]
            yield pd.DataFrame(rows)[schema.names]

    rows = documents.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInPandas(judge, schema)
    run = F.struct(*[F.get("best", F.lit(k)).alias(n) for k, n in enumerate(names)])
    zipped = F.arrays_zip(*[F.col(f"{n}s").alias(n) for n in names])
    return rows.select("id", "n_words", zipped.cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs"),
                       F.when(F.col("best").isNotNull(), run).alias("best"), "collapsed")


def run_text(runs: str = "runs") -> Column:
    """Every run as ``start,length,period`` and a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def with_planted_runs(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A tenth of the texts (crc32 of the id mod 10 is 0) made periodic from some word on; others as they are.

    With h the crc32, g = floor(h / 10) and n words: each word i >= a becomes word a + (i - a) mod p, where a = g mod n and
    p = 1 + floor((n - a) / (3 + g mod 8)). Null ids and texts without words stay.
    """
    hashed = F.crc32(F.col("id").cast("string").cast("binary"))
    split = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = documents.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = rows.select("id", "text", F.floor(hashed / 10).alias("g"), F.when(hashed % 10 == 0, split).alias("w"))
    many = F.size("w")
    rows = rows.withColumn("a", F.when(many > 0, F.col("g") % many).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((many - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    source = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(
        F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select(F.col("id").alias(id), F.when(F.col("a").isNotNull(), F.array_join(source, " ")).otherwise(F.col("text")).alias(text))
