import random
import re
from collections import Counter

from pyspark.sql import functions as F

from cellweft.llm import licence_scan as ls
from cellweft.llm import queries

FOLDER = "/root/testdata/sf0.001"


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_places(words):
    out = []
    for label, phrase in ls.PHRASES.items():
        p = phrase.split()
        out += [(label, i) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return sorted(out)


def plain_matches(words, weights):
    """Best share of each label: every template laid at every place of the text."""
    best = {}
    for template in ls.TEMPLATES:
        own = plain_words(template.text)
        rare = sorted(set(own), key=lambda w: (-weights[w], w))[:ls.RARE]
        total = sum(weights[w] for w in own if w in rare)
        phrases = [p.split() for p in template.mandatory]
        for shift in (0, ls.SLACK // 2):
            cells = {}
            for i, w in enumerate(words):
                for j, x in enumerate(own):
                    if w == x:
                        cell = cells.setdefault((i - j + shift) // ls.SLACK, (set(), set()))
                        if w in rare:
                            cell[0].add(j)
                        cell[1].update(k for k, p in enumerate(phrases) if own[j:j + len(p)] == p and words[i:i + len(p)] == p)
            for places, seen in cells.values():
                got = sum(weights[own[j]] for j in places) / total
                if len(seen) == len(phrases) and got >= ls.SHARE:
                    best[template.label] = max(best.get(template.label, 0), got)
    return best


def plain_weights(texts):
    import math
    vocabulary = {w for t in ls.TEMPLATES for w in plain_words(t.text)}
    many = Counter(w for t in texts for w in set(plain_words(t)) & vocabulary)
    return {w: math.log((1 + len(texts)) / (1 + many[w])) + 1 for w in vocabulary}


def compare(rows, texts):
    weights = plain_weights([t for _, t in texts])
    got = Counter()
    for r in rows:
        best = {}
        for m in r["matches"]:
            best[m["label"]] = max(best.get(m["label"], 0), m["share"])
        got[(r["id"], r["n_words"], tuple(map(tuple, r["places"])), tuple((k, round(v, 9)) for k, v in sorted(best.items())))] += 1
    wanted = Counter()
    for key, text in texts:
        words = plain_words(text)
        best = plain_matches(words, weights)
        wanted[(key, len(words), tuple(plain_places(words)), tuple((k, round(min(v, 1.0), 9)) for k, v in sorted(best.items())))] += 1
    assert got == wanted
    return got


def test_scan_equals_plain_code(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    compare(ls.scan_licences(docs).collect(), texts)


def test_every_template_is_found_whole_and_with_edits(spark):
    rng = random.Random(5)
    texts = []
    for k, template in enumerate(ls.TEMPLATES):
        texts.append((3 * k, f"Some words first. {template.text.upper()}; and words after."))
        own = template.text.split()
        edits = [" ".join(own[:cut] + ["really"] + own[cut:]) for cut in range(len(own) // 2, len(own) + 1)]
        texts.append((3 * k + 1, next(e for e in edits if all(p in " ".join(plain_words(e)) for p in template.mandatory))))
        rng.shuffle(own)
        texts.append((3 * k + 2, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = ls.scan_licences(df).collect()
    compare(rows, texts)
    by_id = {r["id"]: {m["label"] for m in r["matches"]} for r in rows}
    for k, template in enumerate(ls.TEMPLATES):
        assert by_id[3 * k] >= {template.label}
        if len(plain_words(template.text)) > 12:
            assert by_id[3 * k + 1] >= {template.label} and not by_id[3 * k + 2]
    start = next(m["start"] for r in rows if r["id"] == 0 for m in r["matches"])
    assert start == 3


def test_odd_rows(spark):
    notice = "Licensed under CC BY-NC 4.0. All rights reserved"
    texts = [(1, None), (2, ""), (3, "---"), (4, notice), (4, notice), (None, notice), (4, "all rights reserved all rights reserved"),
             (5, "ĀLL RIGHTS RESERVED"), (6, "KK cc\tby cc-by CC"), (7, "cc by " * 40_000), (8, "cc"), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"words": F.lit(1), "hits": F.lit("h"), "t": F.lit(0)})
    got = compare(ls.scan_licences(df).collect(), texts)
    assert sum(got.values()) == len(texts)
    assert ls.scan_licences(df.limit(0)).count() == 0


def test_query_columns(spark):
    rows = {r["doc_id"]: r for r in queries.op11_rare_token_licences(spark, FOLDER).collect()}
    for doc_id, text in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        words, r = plain_words(text), rows[doc_id]
        places = plain_places(words)
        starts = [i for _, i in places]
        base = sorted({label for label, _ in places})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(base))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert set(base) <= set(r["labels"].split(",")) | ({""} if not base else set()) and 0 <= r["score"] <= 1


def test_no_python_in_the_plan(spark):
    plan = queries.op11_rare_token_licences(spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
