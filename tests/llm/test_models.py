import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweft.llm import perplexity as P, pseudo_likelihood as L, quote_links as Q, rule_ensemble as R, vantage as V

DOCS = "doc_id long, text string, lang string, loss int"


def plain_counts(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


ODD = [None, "", " \n\t", "a a a a", "x y $ é\U0001f642 <b>", "same\nsame\n same\n\nsame", "\x1c a b c a b c\r\n", "one two", "w " * 5000]


def test_plain_counts_equal_plain_code(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts + ODD:
        assert P.plain_counts(text) == plain_counts(text)


def test_model_is_a_distribution_and_prefers_what_it_saw():
    grams = np.concatenate([P.grams_of(P.code_points(t)) for t in ("the cat sat on the mat " * 5, "a cat and the dog")])
    seen, n = np.unique(grams, return_counts=True)
    table = P.log_table(P.build_model(seen, n))
    sums = np.exp(table.astype(float)).reshape(-1, 128).sum(1)
    assert sums == pytest.approx(np.ones(len(sums)), abs=1e-3)
    rate = lambda t: table[P.grams_of(P.code_points(t))].mean()
    assert rate("the cat sat") > rate("zq$$ xx##")


def test_low_bits_are_the_suffix_gram():
    grams = P.grams_of(P.code_points("abcdef é\U0001f642\n"))
    other = P.grams_of(P.code_points("zbcdef é\U0001f642\n"))
    assert (grams[3:] & 0x3FFFF == other[3:] & 0x3FFFF).all() and (grams < P.GRAMS).all()


def test_bands_reject_the_odd_one_only(spark):
    rng = np.random.default_rng(1)
    words = ["the", "a", "cat", "dog", "house", "tree", "runs", "sleeps", "near", "under", "green", "old"]
    rows = [(i, " ".join(rng.choice(words, 120)) + f" {i}", "en", 1) for i in range(300)]
    noise = " ".join("".join(rng.choice(list("#*$%&QXZJ"), 14)) for _ in range(120))
    rows += [(900, noise, "en", 1), (901, "too short", "en", 1), (902, None, "en", 1), (903, "cat dog tree " * 40, None, 1), rows[0]]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["id"]: r for r in P.rate_documents(df).collect()}
    assert len(got) == 304 and all(got[i]["kept"] for i in range(300))
    assert not got[900]["kept"] and not got[900]["base_failed"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (901, 902, 903))
    kept = P.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 301
    assert P.rate_documents(df.limit(0)).count() == 0 and P.keep_good(df.limit(0)).count() == 0


def spoken(rng, letters, n, first=0):
    """Texts of 60 words over some letters."""
    return [(first + i, " ".join("".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(60))) for i in range(n)]


def test_languages_do_not_share_a_model(spark):
    rng = np.random.default_rng(6)
    german = ["der", "die", "hund", "katze", "haus", "und", "schläft", "unter", "grün", "alt", "baum", "läuft"]
    spanish = ["el", "la", "perro", "gato", "casa", "y", "duerme", "bajo", "verde", "viejo", "árbol", "corre"]
    rows = [(i, " ".join(rng.choice(german, 120)) + f" {i}", "de", 1) for i in range(200)]
    rows += [(500 + i, " ".join(rng.choice(spanish, 120)) + f" {i}", "es", 1) for i in range(200)]
    rows += [(900, " ".join(rng.choice(spanish, 120)), "de", 1), (901, " ".join(rng.choice(german, 120)), "es", 1)]
    got = {r["id"]: r["kept"] for r in P.rate_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got[900] and not got[901]  # "de" and "es" once fell into one model
    assert all(kept for i, kept in got.items() if i < 900)


def test_bands_of_unspaced_scripts(spark):
    rng = np.random.default_rng(8)
    signs = [chr(0x4e00 + k) for k in range(900)]
    clause = lambda: "".join(rng.choice(signs, rng.integers(15, 60)))
    rows = [(i, " ".join(clause() for _ in range(80)), "zh", 1) for i in range(200)]
    rows += [(900, " ".join(clause() * 12 for _ in range(80)), "zh", 1)]
    got = {r["id"]: r for r in P.rate_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert min(r["loss"] for r in got.values()) > 81
    assert all(got[i]["kept"] for i in range(200)) and not got[900]["kept"] and not got[900]["base_failed"]


def test_bins_cover_all_losses(spark):
    losses = [0.0, 0.019, 1.0, 79.99, 80.0, 80.03, 123.4, 5e3, 1e9]
    bins = P.bin_of(F.col("loss"))
    rows = spark.createDataFrame([(x,) for x in losses], "loss double").select("loss", bins.alias("bin"), P.start_of(bins).alias("start")).collect()
    assert all(r["start"] <= r["loss"] * (1 + 1e-12) and r["loss"] - r["start"] <= max(P.BIN, r["loss"] / P.BINS) * (1 + 1e-9) for r in rows)
    assert [r["bin"] for r in rows] == sorted(r["bin"] for r in rows)


def test_many_languages_in_rounds_equal_one_model_each(spark, monkeypatch):
    rng = np.random.default_rng(7)
    names = [None, "", *[f"l{k}" for k in range(12)]]
    rows = [(100 * k + i, t, lang, 1) for k, lang in enumerate(names) for i, t in spoken(rng, "abcdefghij"[k % 5:k % 5 + 6], 3)]
    rows += [(9000, None, "l1", 1), (9001, "", "no model", 1)]
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(P, "ROUND_GRAMS", P.GRAMS + P.MODEL_COST + 3 * (P.MODEL_COST + 400))
    models = P.train(df)
    assert P.rounds_of(models).select("round").distinct().count() > 2
    got = {r["id"]: r["loss"] for r in P.rate_documents(df).collect()}
    assert len(got) == len(rows) and got[9000] is None and got[9001] is None
    for lang in names:
        own = [(i, t) for i, t, name, _ in rows if name == lang and t]
        seen, n = np.unique(np.concatenate([P.grams_of(P.code_points(t)) for _, t in own]), return_counts=True)
        table = P.log_table(P.build_model(seen, n))
        for i, t in own:
            assert got[i] == pytest.approx(P.total_loss(t, table) / 60, rel=1e-6)


def test_lookup_equals_the_dense_table():
    seen, n = np.unique(P.grams_of(P.code_points("the cat sat on the mat " * 5)), return_counts=True)
    orders = P.build_model(seen, n)
    grams = P.grams_of(P.code_points("the dog sat é on a mat"))
    assert (P.log_lookup(orders, grams) == P.log_table(orders)[grams]).all()


def test_tree_paths_become_rules():
    text = """RandomForest
  If (feature 0 <= 0.5)
   If (feature 1 <= 2.0)
    Predict: 0.0
   Else (feature 1 > 2.0)
    Predict: 1.0
  Else (feature 0 > 0.5)
   Predict: 1.0"""
    inf = math.inf
    assert [r.bounds for r in R.tree_rules(text)] == [
        ((0, -inf, 0.5),), ((0, -inf, 0.5), (1, -inf, 2.0)), ((0, -inf, 0.5), (1, 2.0, inf)), ((0, 0.5, inf),)]


def test_quality_learns_from_training_rows_only(spark):
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(240):
        good = i % 3 > 0
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 8))) for _ in range(60)]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), "en", 1))
        marks.append((i, int(good)))
    rows += [(990, None, "en", 1), (991, "", "en", 1), (None, "no id", "en", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame(marks + [(990, None)], "doc_id long, quality int")
    got = {r["id"]: r for r in R.rate_quality(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    import zlib
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[i]["score"] >= 0.7) == bool(q) for i, q in marks if got[i]["held_out"]]
    assert sum(held) >= 0.95 * len(held)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["id"]: r["score"] for r in R.rate_quality(docs, flipped).collect()}
    assert again == pytest.approx({i: r["score"] for i, r in got.items()})


def test_quality_without_two_kinds(spark):
    docs = spark.createDataFrame([(1, "a", "en", 1), (2, None, "en", 1)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in R.rate_quality(docs, none).collect()} == {0.5}
    assert {r["score"] for r in R.rate_quality(docs, none.union(spark.createDataFrame([(1, 1)], none.schema))).collect()} == {1.0}
    assert R.rate_quality(docs.limit(0), none).count() == 0


def inner(v, w):
    total = 0.0
    for a, b in zip(v, w):
        total += a * b  # sum() would compensate rounding
    return total


def brute_nearest(rows, k):
    good = [(n, i, [float(np.float32(x)) for x in v]) for n, (i, v) in enumerate(rows)
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, q, v in good:
        if q % 20:
            continue
        found = sorted((-inner(v, w), i) for m, i, w in good if m != n and len(w) == len(v))[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("leaf", [8, 512])
def test_trees_equal_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(V, "LEAF", leaf)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, 0.0, 0.0, 1.0, 0.0]) for i in range(60)] + [(400, None), (420, []), (440, [0.0] * 6), (None, [1.0] * 6)]
    rows += [(460, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (480, [float("nan")] * 6), (500, [float("inf")] * 6), (520, [1.0, 2.0]), rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = V.nearest(df, F.col("id") % 20 == 0, k=7, shard_rows=90, query_rows=5).collect()
    want = brute_nearest(rows, 7)
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == want
    near = V.nearest(df, F.col("id") % 20 == 0, k=7, factor=1.3, shard_rows=90).collect()
    hits = {(r["query_id"], r["id"]) for r in near} & {(q, i) for q, _, i, _ in want}
    assert len(hits) >= 0.9 * len({(q, i) for q, _, i, _ in want})
    assert V.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_ties_of_equal_unit_vectors_go_to_the_smaller_ids():
    rng = np.random.default_rng(10)
    for _ in range(20):
        vector = rng.normal(size=64)
        vector /= np.linalg.norm(vector)
        points = np.tile(vector, (1500, 1))
        longest = math.sqrt(inner(vector, vector))
        extra = np.sqrt(np.maximum(longest**2 - (points**2).sum(1), 0))
        order, nodes = V.build_tree(np.column_stack([points, extra]))
        ids = rng.permutation(1500)
        search = V.Search(points, extra[order], np.arange(1500)[order], ids[order], nodes, points[:1], np.array([-5]), longest, 20, 1.0)
        search.visit(0, np.arange(1))
        assert search.ids[search.who[0]].tolist() == list(range(20))


def test_check_sql_of_the_search(spark):
    import duckdb

    from cellweft.llm.queries import OP6_SQL
    from cellweft.plans.registry import QUERIES
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = sorted(con.sql(OP6_SQL).fetchall())
    got = QUERIES["op6_vantage_trees"](spark, "/root/testdata/sf0.001").select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == want


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    flat = L.start(1).astype(np.float64)
    windows, words = rng.integers(0, L.SLOTS, (4, 50)), rng.integers(1, L.SLOTS, 50)
    g = L.gradients(L.unpack(flat), windows, words)
    loss = lambda x: -L.log_probs(L.unpack(x), windows, words).mean()
    model = L.unpack(np.arange(L.SIZE))
    high = int(words[0]) // 256
    picks = [int(model["hidden"][3]), int(model["out"][0, 2, 5]), int(model["out"][2, 1, 7]), int(model["digit"][0, 2, high]),
             int(model["digit"][1, 3, int(words[0]) // 16 % 16]), int(model["window"][1, windows[1, 0], 4]), int(model["bias"][0, high])]
    for k in picks:
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert g[k] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-2, abs=1e-6)


def test_probabilities_add_up_to_one():
    model = L.unpack(L.start(2))
    every = np.arange(L.SLOTS)
    assert np.exp(L.log_probs(model, np.tile([[3], [9], [27], [81]], (1, L.SLOTS)), every)).sum() == pytest.approx(1.0, abs=1e-4)


def test_pseudo_likelihood_prefers_the_trained_order(spark):
    cycle = " ".join(itertools.islice(itertools.cycle(["red", "green", "blue", "black", "white", "grey"]), 240))
    jumbled = " ".join(np.random.default_rng(5).permutation(cycle.split()))
    rows = [(i, cycle, "en", 1) for i in range(300)] + [(900, jumbled, "en", 1), (901, None, "en", 1), (902, "", "en", 1), (903, "lone", "en", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x"))
    got = {r["id"]: r for r in L.score_documents(df, stride=1, rounds=3).collect()}
    assert got[0]["n_words"] == 240 and got[0]["mean_score"] > got[900]["mean_score"] + 0.5
    assert (got[901]["score"], got[901]["mean_score"], got[902]["n_words"]) == (0.0, None, 0) and got[903]["score"] < 0
    assert L.score_documents(df.limit(0)).count() == 0


def test_scores_equal_plain_sums(spark):
    """A fixed model, word by word in plain Python: the score is the sum of the log-probabilities of all words."""
    import math

    import xxhash
    texts = ["a b c a b", "lone", "", None, "x y z " * 70, "é ü"]
    model = {k: v.astype(float) for k, v in L.unpack(L.start(7)).items()}

    def log_soft(x, k):
        return x[k] - math.log(sum(math.exp(v) for v in x))

    wanted = []
    for text in texts:
        slots = [xxhash.xxh64_intdigest(w.encode()) % (L.SLOTS - 1) + 1 for w in (text or "").split()]
        padded, total = [0, 0, *slots, 0, 0], 0.0
        for i, s in enumerate(slots):
            layer = np.tanh(sum(model["window"][k][padded[i + 2 + p]] for k, p in enumerate(L.PLACES)) + model["hidden"])
            for k, digit in enumerate((s // 256, s // 16 % 16, s % 16)):
                total += log_soft(layer @ model["out"][k] + model["bias"][k], digit)
                if k < 2:
                    layer = np.tanh(layer + model["digit"][k][:, digit])
        wanted.append(total)
    windows, words, row = L.examples(texts)
    got = np.bincount(row, L.log_probs(L.unpack(L.start(7)), windows, words), minlength=len(texts))
    assert got == pytest.approx(wanted, rel=1e-4)


def test_every_word_trains(spark):
    for text in ("lone", "red green", "black white grey", "a b c d e"):
        rows = spark.createDataFrame([(text,)], "text string")
        assert not np.array_equal(L.train(rows), L.start(5))  # with every 8th word, short texts gave no example


def test_own_parameters_prefer_the_trained_order(spark):
    cycle = " ".join(itertools.islice(itertools.cycle(["red", "green", "blue", "black", "white", "grey"]), 240))
    jumbled = " ".join(np.random.default_rng(5).permutation(cycle.split()))
    df = spark.createDataFrame([(i, cycle, "en", 1) for i in range(3000)] + [(9000, jumbled, "en", 1)], DOCS)
    got = {r["id"]: r["mean_score"] for r in L.score_documents(df.coalesce(4)).filter("id % 3000 = 0").collect()}
    assert got[0] > got[9000] + 0.5


CHAT = [
    ("a", 0, "user", "How do I sort?\nAnd also filter?"), ("a", 1, "bot", "Use orderBy.\n\nIt sorts."),
    ("a", 2, "user", "unrelated"), ("a", 3, "user", "Ann wrote:\n> Use  ORDERBY.\n\nthanks"),
    ("a", 4, "user", "more"), ("a", 5, "bot", ">> use orderby.\n> thanks\nwelcome"), ("a", 6, "bot", "> never said\nhm"),
    ("a", 7, "user", "> And also filter?\nfilter is where"), ("b", 0, "user", "> Use orderBy.\nother chat"),
    (None, 0, "user", None), (None, 1, "bot", ""), ("a", None, "user", "> thanks\nlost"), ("c", 5, "user", "x"), ("c", 5, "user", "x"),
]


@pytest.mark.parametrize("chunk", [1024, 2])
def test_quotes_link_and_order(spark, monkeypatch, chunk):
    monkeypatch.setattr(Q, "CHUNK", chunk)
    df = spark.createDataFrame(CHAT, "conv_id string, turn long, role string, text string").withColumn("parent", F.lit(1))
    rows = Q.link_quotations(df).collect()
    assert len(rows) == len(CHAT)
    got = {(r["conv"], r["turn"]): r for r in rows}
    link = {k: (r["parent_turn"], r["linked_by"]) for k, r in got.items()}
    assert [link["a", t] for t in range(8)] == [(None, None), (0, "previous"), (1, "previous"), (1, "quote"), (3, "previous"),
                                                (3, "quote"), (5, "previous"), (0, "quote")]
    assert link["b", 0] == (None, None) and link[None, 1] == (0, "previous") and link["a", None] == (None, None)
    assert got["a", 3]["text"] == "thanks" and got["a", 5]["text"] == "welcome" and got[None, 0]["text"] == ""
    order = [r["turn"] for r in rows if r["conv"] == "a" and r["turn"] is not None]
    assert order == [0, 7, 1, 3, 5, 6, 4, 2]
    assert [r["reply_path"] for r in rows if r["conv"] == "c"] == [[5], [5]]
    assert Q.link_quotations(df.limit(0)).count() == 0


def test_passages_keep_levels():
    assert Q.passages("a\nb\n\nc\n> d\n>> e\n>> f\n> > g") == [(0, ["a", "b"]), (0, ["c"]), (1, ["d"]), (2, ["e", "f", "g"])]
    assert pd.notna(Q.hash_of("x"))
