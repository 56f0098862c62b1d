import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.llm import hyperminhash as H
from cellweft.llm.components import components
from cellweft.llm.words import shingle_set


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if len(words) >= 5 else frozenset([tuple(words)])


def plain_components(rows):
    """Smallest id reachable, by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return [least.get(find(k)) if sets[k] else rows[k][0] for k in range(len(rows))], [len(s) for s in sets]


def family(rng, vocabulary, count, size, edits):
    base = [rng.choice(vocabulary) for _ in range(size)]
    texts = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(size)] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    return texts


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [t for n, size, edits in ((40, 90, 5), (12, 30, 2), (5, 6, 1), (3, 400, 12)) for t in family(rng, vocabulary, n, size, edits)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [shared + " " + " ".join(rng.choice(vocabulary) for _ in range(50)) for _ in range(30)]
    texts += ["A b c", "a\tB\nc", "a b c d", "one", "ONE", "", None, " \n ", "été Été", "É", "É"] + [texts[0]] * 20
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [rows[0], (None, texts[0]), (None, "lonely words of no id at all"), (None, None)]


def test_groups_equal_all_pairs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "kept": F.lit("x")})
    got = [tuple(r) for r in H.near_duplicates(df).collect()]
    roots, sizes = plain_components(rows)
    want = [(doc, n, root, doc == root) for (doc, _), root, n in zip(rows, roots, sizes)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_small_blocks_give_the_same_groups(spark, rows, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["id"], r["component_id"]) for r in H.near_duplicates(df).collect()), key=repr)
    assert got == sorted(((doc, root) for (doc, _), root in zip(rows, plain_components(rows)[0])), key=repr)


def test_one_per_group_keeps_each_group_once(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, name string")
    kept = H.one_per_group(df)
    assert kept.columns == df.columns
    roots, sizes = plain_components(rows)
    want = sorted({root for (d, _), root, n in zip(rows, roots, sizes) if n and root is not None})
    got = kept.collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None and plain_set(r["text"])) == want
    assert sum(1 for r in got if not plain_set(r["text"])) == sum(1 for n in sizes if not n)
    assert sum(1 for r in got if r["doc_id"] is None and r["text"]) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert H.near_duplicates(df).count() == 0 and H.one_per_group(df).count() == 0


def test_registers_hold_zeros_and_mantissa():
    shingles = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    regs = H.registers(shingles)
    for bucket in range(H.REGISTERS):
        rest = min((int(s) & (2**57 - 1) for s in shingles if int(s) >> 57 == bucket), default=None)
        if rest is None:
            assert regs[bucket] == H.EMPTY
            continue
        bits = f"{rest:057b}"
        zeros = len(bits) - len(bits.lstrip("0"))
        tail = (bits[zeros + 1:] + "1" + "0" * 10)[:10]
        assert regs[bucket] == (zeros << 10 | int(tail, 2))


def test_estimate_is_close_to_the_similarity():
    rng = np.random.default_rng(2)
    found = []
    for _ in range(200):
        both = rng.integers(0, 2**64, 800, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, 100, dtype=np.uint64)])) for _ in range(2))
        found.append(H.estimate(H.registers(a), H.registers(b)[None], len(a), np.array([len(b)]))[0][0])
    assert np.mean(found) == pytest.approx(0.8, abs=0.01)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(7, 7), (6, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 5 for k in range(5, 40)}}


def test_short_texts_are_one_shingle():
    assert len(shingle_set("a b c")) == 1 and len(shingle_set("a b c d e f")) == 2 and not len(shingle_set(" \t"))
