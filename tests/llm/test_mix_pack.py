import math
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Whitespace

from cellweft.errors import DataError
from cellweft.llm import packing, pivotal

FILE = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


def plain_targets(sizes):
    """The excess of capped sources shared out again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        given = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s, g in given.items():
            target[s] += g
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def mixed_rows(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "block": F.lit(1)})
    return pivotal.mix_sources(df, **options).collect()


ROWS = [(i, "w " * (1 + (i * 37) % 50), f"s{i % 4}") for i in range(400)]
ROWS += [(i, "x y z", "big") for i in range(400, 900)] + [(900, None, "s1"), (901, "", None), (902, "a b", None), (903, " ", "empty")]
ROWS += [ROWS[5], (None, "a b c", "s2"), (904, "one\ttwo\u00a0three\x0bfour", "é")]


@pytest.mark.parametrize("options", [{}, {"block_rows": 10, "fan": 3}])
def test_mix_meets_targets(spark, options):
    got = mixed_rows(spark, ROWS, **options)
    assert len(got) == len(ROWS)
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = plain_targets(sizes)
    taken, largest = {}, {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert r["taken"] == r["copies"] * r["size"] or r["size"] == 0
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)
    again = mixed_rows(spark, ROWS[::-1], **options)
    key = lambda r: (repr(r["id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_of_nothing(spark):
    assert mixed_rows(spark, []) == []
    assert [r["taken"] for r in mixed_rows(spark, [(1, None, None), (2, " ", "a")])] == [0, 0]


def test_rows_of_one_id_mix_in_blocks(spark, monkeypatch):
    seen, inner = [], pivotal.round_blocks

    def watch(rows, *rest):
        seen.append(rows.groupBy("source", "block").count().agg(F.max("count")).first()[0] or 0)
        return inner(rows, *rest)

    monkeypatch.setattr(pivotal, "round_blocks", watch)
    df = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"),
                                    F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"))
    got = pivotal.mix_sources(df, block_rows=4_000).groupBy("source").agg(F.count("*"), F.sum("taken"), F.max("target")).collect()
    assert max(seen) < 8_000 and len(got) == 2
    assert all(n == 30_000 and abs(taken - target) <= 3 for _, n, taken, target in got)


def test_rounding_keeps_the_sum_and_is_fair():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 100, 60).astype(float)
    shares = rng.random(60)
    mean = np.zeros(60)
    for seed in range(400):
        out, held = pivotal.settle(sizes, shares, [str(k) for k in range(60)], seed, "t")
        assert (sizes * out).sum() == pytest.approx((sizes * shares).sum())
        assert all(x in (0.0, 1.0) for k, x in enumerate(out) if k != held)
        mean += out / 400
    assert np.abs(mean - shares).max() < 0.12


def test_repeat_rows_follows_the_mix(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    out = pivotal.repeat_rows(df)
    assert out.columns == df.columns
    mixed = pivotal.mix_sources(df).filter("size > 0").groupBy("id").agg(F.sum("copies").alias("n")).collect()
    want = {r["id"]: r["n"] for r in mixed if r["n"]}
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert {k: v for k, v in got.items() if k in want} == want
    assert set(got) - set(want) <= {900, 901, 903}


TEXTS = ["plain words, and more's", "", None, "a  b", " lead", "trail ", "tab\t x", "x\n\ny z", "é日本 🙂 <|endoftext|> z", "\u00a0 q",
         "it's we'll I'd  ", "1234 5.6 $$$ !!", "a\u2003 b", "x\x1c y", "<|endoftext|>"]


def test_ids_equal_the_files_tokenizer(spark):
    tokenizer, made = Tokenizer.from_file(FILE), packing.Encoder(FILE)
    given = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    for text in [*TEXTS, *given, *given[:5]]:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(made.encode(text), "<u4").tolist() == want, text


def test_memory_of_parts_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_SIZE", 3)
    made = packing.Encoder(FILE)
    first = made.encode("some words that fill it up")
    assert made.encode("other words that fill it again") and made.encode("some words that fill it up") == first and len(made) < 9


def test_ids_of_odd_strings():
    from hypothesis import given, settings, strategies as st

    tokenizer, made = Tokenizer.from_file(FILE), packing.Encoder(FILE)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=" \t\n\u00a0\u2003\x1c\x85ab'sS.1é日🙂", max_size=30))
    def check(text):
        assert np.frombuffer(made.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids

    check()


@pytest.mark.parametrize("block_rows", [20_000, 15])
def test_packing_is_whole(spark, block_rows):
    base = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", F.lit(1).alias("offset"))
    extra = spark.createDataFrame([(1000 + k, t, 1) for k, t in enumerate(TEXTS)] + [(1000, TEXTS[0], 1), (None, "no id", 1)],
                                  "doc_id long, text string, offset int")
    docs = base.unionByName(extra)
    got = packing.pack_documents(docs, FILE, block_rows=block_rows).collect()
    tokenizer = Tokenizer.from_file(FILE)
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) - 2048 * (math.ceil(len(ids) / 2048) - 1)
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want.append((repr(r["doc_id"]), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((repr(r["id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(w[3] for w in want) / 2048) + 3


@pytest.mark.parametrize("low, high", [(1030, 2000), (200, 1900)])
def test_no_level_holds_more_than_its_blocks(spark, monkeypatch, low, high):
    seen, inner = [], packing.pack_blocks

    def watch(pieces, *rest):
        seen.append(pieces.groupBy("block").count().agg(F.max("count")).first()[0])
        return inner(pieces, *rest)

    monkeypatch.setattr(packing, "pack_blocks", watch)
    lengths = np.random.default_rng(9).integers(low, high, 1000).tolist()
    pieces = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)],
                                   "id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack_pieces(pieces, block_rows=50).collect()
    assert len(seen) > 1 and max(seen) < 2 * 50  # leftovers of all blocks once met in one
    assert sorted((r["id"], r["length"]) for r in got) == list(enumerate(lengths))
    sequences = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 2048
    assert len(sequences) == 1000 if low > 1024 else len(sequences) < 640


def test_packing_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0


def test_local_search_empties_sequences():
    lengths = [6, 6, 5, 5, 4, 4]  # best fit needs four of length 10 in this order, three are enough
    bins = packing.local_search([[0], [1], [2, 4], [3, 5]], lengths, 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(6))
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 60, 80).tolist()
        start = [[k] for k in range(80)]
        found = packing.local_search(start, lengths, 100)
        assert sorted(i for b in found for i in b) == list(range(80))
        assert all(sum(lengths[i] for i in b) <= 100 for b in found) and len(found) < 80


def improving_step(bins, lengths, cap):
    """Plain search over all pairs: a move or exchange that makes the fuller sequence fuller, or None."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: (-fill[k], k))
    for at, k in enumerate(order):
        for o in order[at + 1:]:
            for inward in [*combinations(bins[o], 1), *combinations(bins[o], 2)]:
                for out in [*([None] if len(inward) == 1 else []), *bins[k]]:
                    gain = sum(lengths[i] for i in inward) - (0 if out is None else lengths[out])
                    if 0 < gain <= cap - fill[k]:
                        return k, o, inward, out
    return None


def test_local_search_leaves_no_exchange():
    rng = np.random.default_rng(4)
    for turn in range(150):
        cap = int(rng.choice([20, 60, 100]))
        lengths = rng.integers(1, cap // (1 + turn % 2) + 1, rng.integers(0, 40)).tolist()
        start = packing.best_fit(lengths, cap) if turn % 3 else [[i] for i in range(len(lengths))]
        found = packing.local_search(start, lengths, cap)
        assert sorted(i for b in found for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= cap for b in found) and len(found) <= len(start)
        assert improving_step(found, lengths, cap) is None


def test_rows_of_one_id_spread_over_blocks(spark, monkeypatch):
    seen, inner = [], packing.pack_blocks

    def watch(pieces, *rest):
        seen.append(pieces.groupBy("block").count().agg(F.max("count")).first()[0])
        return inner(pieces, *rest)

    monkeypatch.setattr(packing, "pack_blocks", watch)
    pieces = spark.range(60_000).select(F.lit(None).cast("long").alias("id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
                                        F.lit(300).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    got = packing.pack_pieces(pieces, block_rows=5_000)
    assert got.columns == [*pieces.columns, "sequence_id", "offset"]
    filled = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n"), F.max("n"), F.count("*")).first()
    assert tuple(filled)[:2] == (60_000 * 300, 1_800) and max(seen) < 10_000
    assert 10_000 <= filled[2] <= 10_012  # twelve blocks, at most one sequence more in each


def test_other_splitting_rules_are_refused(tmp_path):
    loaded = Tokenizer.from_file(FILE)
    loaded.pre_tokenizer = Whitespace()
    loaded.save(str(tmp_path / "other.json"))
    with pytest.raises(DataError):
        packing.Encoder(str(tmp_path / "other.json"))
