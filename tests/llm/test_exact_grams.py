import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellweft.llm import exact_grams as E, perplexity as P

DOCS = "doc_id long, text string, lang string"


def units(text):
    raw = text.encode("utf-16-le", "surrogatepass")
    return [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]


def grams(text):
    c = [10, 10, 10, *units(text)]
    return [tuple(c[i:i + 4]) for i in range(len(c) - 3)]


def plain_model(texts):
    """-log p of every gram, by modified Kneser-Ney with dicts; grams of one distinct text give all to the back-off."""
    n, holders = Counter(g for t in texts for g in grams(t)), defaultdict(set)
    for t in texts:
        for g in grams(t):
            for k in range(4):
                holders[g[k:]].add(t)
    orders = [n]
    for _ in range(3):
        orders.append(Counter(g[1:] for g in orders[-1]))
    p = {(): 1 / 65536}
    for counts in reversed(orders):
        of = Counter(counts.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        d = {k: min(max(k - (k + 1) * y * of[k + 1] / of[k] if of[k] else y * k, 0.05 * k), 0.95 * k) for k in (1, 2, 3)}
        total, held = Counter(), Counter()
        off = {g: c if len(holders[g]) == 1 else d[min(c, 3)] for g, c in counts.items()}
        for g, c in counts.items():
            total[g[:-1]] += c
            held[g[:-1]] += off[g]
        p = {g: (c - off[g]) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * p[g[1:]] for g, c in counts.items()}
    return {g: -math.log(x) for g, x in p.items()}


def spoken(rng, letters, n):
    return [" ".join("".join(rng.choice(list(letters), rng.integers(1, 6))) for _ in range(60)) for _ in range(n)]


def odd_languages():
    rng = np.random.default_rng(3)
    rows = [(None, t, lang) for lang, letters in ((None, "abcde"), ("", "ab一冀é"), ("x", "pq\U0001f642\U0001f643\ud800￿"))
            for t in spoken(rng, letters, 6)]
    rows = [(k, t.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), lang) for k, (_, t, lang) in enumerate(rows)]
    return rows + [rows[0], rows[7], (70, "only one text", "y"), (71, None, "x"), (72, "", "z"), (None, "abc abc", None), (None, "abc abc", None)]


def check_against_plain(df, rows):
    got = Counter((r["id"], r["lang"], round(r["exact_loss"], 5) if r["exact_loss"] is not None else None) for r in P.rate_documents(df).collect())
    models = {lang: plain_model([t for _, t, name in rows if name == lang and t]) for lang in {r[2] for r in rows}}
    loss = lambda t, m: round(sum(m[g] for g in grams(t)) / len(t.split()), 5) if t else None
    want = Counter((k, lang, loss(t, models[lang])) for k, t, lang in rows)
    order = lambda c: sorted(c.elements(), key=str)
    assert [x[:2] for x in order(got)] == [x[:2] for x in order(want)]
    assert [x[2] or 0 for x in order(got)] == pytest.approx([x[2] or 0 for x in order(want)], abs=2e-5)


def test_exact_loss_equals_plain_code(spark):
    rows = odd_languages()
    check_against_plain(spark.createDataFrame(rows, DOCS), rows)


def test_rare_grams_are_joined(spark, monkeypatch):
    rows = odd_languages()
    df = spark.createDataFrame(rows, DOCS)
    for hot in (40, 0):
        monkeypatch.setattr(E, "HOT", hot)
        known, rare = E.hot_and_rare(E.exact_costs(df))
        assert known.count() <= hot and rare.count() > 0
        check_against_plain(df, rows)
    assert P.keep_good(df.limit(0)).count() == 0


def test_every_gram_is_told_apart(spark):
    text = "Aa bb 一冀 \U0001f642\U0001f643 zz"
    assert len(set(E.exact_grams(text).tolist())) == len(set(grams(text)))
    # Folded grams of these two are equal: the second's signs lie 896 code points on.
    assert (P.grams_of(P.code_points("一丁丂")) == P.grams_of(P.code_points("冀冁冂"))).all()
    assert not set(E.exact_grams("一丁丂").tolist()) & set(E.exact_grams("冀冁冂").tolist())


def test_texts_alike_after_the_fold_are_judged_apart(spark):
    rng = np.random.default_rng(8)
    clause = lambda first: "".join(chr(first + k) for k in rng.integers(0, 800, rng.integers(15, 60)))
    rows = [(i, " ".join(clause(0x4e00) for _ in range(80)), "zh") for i in range(200)]
    rows += [(900, " ".join(clause(0x5180) for _ in range(80)), "zh")]  # other signs, 896 further on
    df = spark.createDataFrame(rows, DOCS)
    got = {r["id"]: r["kept"] for r in P.rate_documents(df).collect()}
    assert all(got[i] for i in range(200)) and not got[900]
    assert sorted(r["doc_id"] for r in P.keep_good(df).collect()) == list(range(200))
