import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.llm import periodic_runs as pr
from cellweft.llm import queries

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every maximal stretch by comparing all words a period apart."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_squared_differences_equal_sums_of_products():
    rng = np.random.default_rng(3)
    for prime in pr.PRIMES:
        blocks, windows = rng.integers(0, 1 << 20, (5, 16)), rng.integers(0, 1 << 20, (5, 32))
        got = pr.squared_differences(blocks, windows, 16, prime)
        for r in range(5):
            for lag in range(16):
                wanted = sum((int(a) - int(b)) ** 2 for a, b in zip(blocks[r], windows[r, lag:lag + 16])) % prime
                assert got[r, lag] == wanted


def test_a_sum_that_is_a_multiple_of_the_first_prime_is_no_match():
    # 8 * m * m is a multiple of no prime below the bound, so a difference of whole primes is planted.
    numbers = np.zeros(64, np.int64)
    numbers[8:16] = pr.PRIMES[0]
    at, distance = pr.block_matches(numbers, np.array([0]), np.array([pr.PRIMES[0] + 1]), 8, 1, 15, 32)
    assert distance.tolist() == []


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_plain_comparison(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        words = []
        for _ in range(rng.randint(0, 6)):
            alphabet = [b"w%d" % i for i in range(rng.choice([1, 2, 3, 40]))]
            unit = [rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 60]))]
            words += (unit * 12)[:rng.randint(1, 5 * len(unit) + 20)]
            if rng.random() < 0.3:
                words = (words * 4)[:rng.randint(1, 700)]
        texts.append(words)
    assert pr.find_runs(texts) == [plain_runs(t) for t in texts]


def test_long_text_of_one_word_and_many_blocks(monkeypatch):
    assert pr.find_runs([[b"a"] * 200_000, [b"b"] * 23, []]) == [[(0, 200_000, 1)], [], []]
    monkeypatch.setattr(pr, "MATRIX", 64)
    words = [b"%d" % (i % 37) for i in range(500)]
    assert pr.find_runs([words]) == [plain_runs(words)] == [[(0, 500, 37)]]


def test_odd_rows(spark):
    long = "x y z " * 60_000
    rows = [(1, None, 5), (1, "", 6), (2, "a " * 30, 7), (2, "a " * 30, 7), (None, " b\t" * 24, 8), (3, long, 9), (4, "a b " * 23, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumns({"best": F.lit(1), "id": F.lit("q")})
    got = sorted((r["id"] or 0, r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in pr.periodic_runs(df).collect())
    assert got == [(0, 24, ((0, 24, 1),), " b"), (1, 0, (), ""), (1, 0, (), ""), (2, 30, ((0, 30, 1),), "a"),
                   (2, 30, ((0, 30, 1),), "a"), (3, 180_000, ((0, 180_000, 3),), "x y z"),
                   (4, 23, (), " ".join(["a b"] * 23))]
    assert pr.periodic_runs(df.limit(0)).count() == 0


def test_query_equals_plain_code(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = planted(doc_id, (text or "").encode().split())
        runs, r = plain_runs(words), got[doc_id]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(kept)).hexdigest()
