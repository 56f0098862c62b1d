"""Licence notices in texts, by a positional index of the rare words of licence templates.

Every template is listed under its words of highest inverse document frequency, counted over all texts, with
the places where they stand in it. A text looks up the words of its own that the index holds; each hit says where
the template would begin. Hits that agree on that beginning add up, and the template is found where they hold
enough of its rare words' weight and its mandatory phrases stand there too. DataFrame functions only.
"""

from __future__ import annotations

import json
import math
import string
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import tune, written

#: Characters between words; A-Z are lower-cased before.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words a template is listed under.
RARE = 12
#: Words by which hits may disagree on where the template begins (inserted or left-out words).
SLACK = 8
#: Share of the rare words' weight that must agree.
SHARE = 0.6
#: Places a template can be listed under; each is one bit of a long.
MOST_PLACES = 62

# Phrases whose every place is reported, and notices of public licences.
PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: tuple[str, ...]


TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
             "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
             ("apache license version 2 0", "except in compliance with the license")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
             "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
             ("permission is hereby granted free of charge", "sublicense and or sell copies")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3",
             ("gnu general public license version 3",)),
    Template("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
             "later version", ("gnu general public license as published", "version 3 of the license")),
    Template("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
             "later version", ("gnu general public license as published", "version 2 of the license")),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation", ("gnu lesser general public license as published",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License",
             ("creative commons attribution 4 0 international",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
             "conditions and the following disclaimer",
             ("redistribution and use in source and binary forms", "redistributions of source code must retain")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted, provided that the above copyright notice and this permission notice appear in all copies",
             ("distribute this software for any purpose", "fee is hereby granted")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
             ("mozilla public license v 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("unencumbered software released into the public domain",)),
)


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased: runs of a-z, 0-9 and characters above U+007F; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, GAPS), lambda w: w != "")


def _plain_words(text: str) -> list[str]:
    kept = [c if c.isdigit() or c.islower() else " " for c in text.lower()]
    return "".join(kept).split()


def inverse_frequencies(words: DataFrame, vocabulary: Sequence[str]) -> dict[str, float]:
    """ln((1 + N) / (1 + n)) + 1 of each word of ``vocabulary``: N texts, n of them hold the word.

    One row per word of the templates comes back, whatever the number of texts.
    """
    held = words.select(F.array_intersect(F.lit(list(vocabulary)), "words").alias("held"))
    marks = F.explode(F.concat(F.array(F.lit(None).cast("string")), "held")).alias("word")  # null counts the text itself
    many = {r["word"]: r["n"] for r in held.select(marks).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((1 + many.get(None, 0)) / (1 + many.get(w, 0))) + 1 for w in vocabulary}


def _constant(rows: Sequence[tuple], **kinds: str) -> Column:
    """Rows of a fixed table as one constant array of structs."""
    text = json.dumps([dict(zip(kinds, row)) for row in rows])
    return F.from_json(F.lit(text), "array<struct<" + ", ".join(f"{name}: {kind}" for name, kind in kinds.items()) + ">>")


@dataclass(frozen=True)
class Index:
    """The templates as constants of the plan; a few rows per template.

    ``rare``: (word, t, place, bit) of every place of a template's rare words; ``heads``: (phrase, t, place, bit) of its mandatory
    phrases; ``totals``: (t, label, words, phrases, held, shares), the shares one per bit; ``words`` by falling weight.
    """

    rare: Column
    heads: Column
    totals: Column
    words: list[str]


def template_index(templates: Sequence[Template], weights: dict[str, float], rare: int = RARE) -> Index:
    postings, heads, totals, listed = [], [], [], set()
    for t, template in enumerate(templates):
        words = _plain_words(template.text)
        places: list[tuple[int, str]] = []
        for w in sorted(set(words), key=lambda w: (-weights[w], w))[:rare]:
            own = [(i, w) for i, x in enumerate(words) if x == w]
            if len(places) + len(own) > MOST_PLACES:
                raise ValueError(f"the rare words of {template.label!r} stand at more than {MOST_PLACES} places")
            places += own
        total = sum(weights[w] for _, w in places)
        totals.append((t, template.label, len(words), list(template.mandatory), [w for _, w in places], [weights[w] / total for _, w in places]))
        postings += [(w, t, i, 1 << k) for k, (i, w) in enumerate(places)]
        listed |= {w for _, w in places}
        for k, phrase in enumerate(template.mandatory):
            parts = phrase.split()
            own = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
            if not own:
                raise ValueError(f"the template of {template.label!r} does not hold its phrase {phrase!r}")
            heads += [(phrase, t, i, 1 << k) for i in own]
    return Index(_constant(postings, word="string", t="int", place="int", bit="bigint"),
                 _constant(heads, phrase="string", t="int", place="int", bit="bigint"),
                 _constant(totals, t="int", label="string", words="int", phrases="array<string>", held="array<string>", shares="array<double>"),
                 sorted(listed, key=lambda w: (-weights[w], w)))


def scan_licences(documents: DataFrame, id: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES,
                  phrases: dict[str, str] = PHRASES, rare: int = RARE, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """Per row: id, n_words, places (array of label, start: every place of a phrase), matches (array of label, start, words, share).

    ``matches`` are the templates found: ``start`` is the word where the template begins (before 0 if its beginning is
    missing), ``share`` the part of its rare words' weight that stands where it should. Hits whose beginnings differ
    by at most ``slack`` / 2 words always meet, those by ``slack`` or more never do. A template is looked for where the text holds
    ``share`` of its rare words' weight and all its mandatory phrases at any place, which every match needs. Whole texts are read, and
    every hit counts: nothing is cut off by number. A null or empty text has no words, places or matches. Rows of one id and one text
    are judged alike and all returned; a null id is kept; other columns are left out, whatever their names. An empty table gives
    an empty one. The texts are read twice (word frequencies, then a written table of hits); hits shuffle as one bit sum
    per (text, template, beginning), so a long text or a frequent word is no hot task.
    """
    spark = tune(documents.sparkSession)
    source = documents.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    words = source.select("id", F.xxhash64("text").alias("mark"), words_of(F.col("text")).alias("words"))
    vocabulary = sorted({w for t in templates for w in _plain_words(t.text)})
    index = template_index(templates, inverse_frequencies(words, vocabulary), rare)
    sought = sorted({*phrases.values(), *(m for t in templates for m in t.mandatory)})
    heads, longest = sorted({p.split()[0] for p in sought}), max(len(p.split()) for p in sought)

    def places(test: Callable[[Column], Column]) -> Column:
        """Numbers of the words that pass a test."""
        every = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: test(F.get("words", i)))
        return F.when(F.size("words") > 0, every).otherwise(F.array().cast("array<int>"))

    follow = lambda i: F.concat(F.array_join(F.slice("words", i + 1, longest), " "), F.lit(" "))
    seen = words.withColumn("held", F.array_intersect(F.lit(index.words), "words"))
    seen = seen.withColumn("ahead", F.transform(places(lambda w: w.isin(heads)), lambda i: F.struct(i.alias("at"), follow(i).alias("text"))))
    seen = seen.withColumn("standing", F.flatten(F.transform("ahead", lambda a: F.transform(
        F.filter(F.lit(sought), lambda p: a["text"].startswith(F.concat(p, F.lit(" ")))),
        lambda p: F.struct(a["at"].alias("at"), p.alias("phrase"))))))
    weight = lambda t: F.aggregate(F.zip_with(t["held"], t["shares"], lambda w, x: F.when(
        F.array_contains("held", w), x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    likely = F.filter(index.totals, lambda t: (F.size(F.array_except(t["phrases"], F.col("standing.phrase"))) == 0)
                      & (weight(t) >= share - 1e-9))
    seen = seen.withColumn("likely", likely)
    look = F.array_distinct(F.flatten("likely.held"))
    seen = seen.withColumn("look", look).withColumn("hits", F.when(F.size("likely") > 0, F.transform(
        places(lambda w: F.array_contains("look", w)), lambda i: F.struct(i.alias("at"), F.get("words", i).alias("word")))))
    seen = written(seen.select("id", "mark", F.size("words").cast("bigint").alias("n_words"), "standing",
                               F.col("likely.t").alias("likely"), "hits"), "licence-hits")

    def small(constant: Column) -> DataFrame:
        return F.broadcast(spark.range(1).select(F.inline(constant)))

    none = F.lit(0).cast("bigint")
    rare_hits = seen.select("id", "mark", "likely", F.explode("hits").alias("hit")).select("id", "mark", "likely", "hit.*")
    rare_hits = rare_hits.join(small(index.rare), "word").withColumns({"bits": F.col("bit"), "phrase_bits": none})
    phrase_hits = seen.filter(F.size("likely") > 0).select("id", "mark", "likely", F.explode("standing").alias("hit")).select("id", "mark", "likely", "hit.*")
    phrase_hits = phrase_hits.join(small(index.heads), "phrase").withColumns({"bits": none, "phrase_bits": F.col("bit")})
    columns = ("id", "mark", "likely", "t", (F.col("at") - F.col("place")).alias("start"), "bits", "phrase_bits")
    found = rare_hits.select(*columns).unionByName(phrase_hits.select(*columns)).filter(F.array_contains("likely", F.col("t")))
    # Two grids of width slack, half a width apart: beginnings that differ by no more than half meet in one cell of either.
    found = found.withColumn("grid", F.explode(F.array(F.lit(0), F.lit(1))))
    cell = F.floor((F.col("start") + F.col("grid") * (slack // 2)) / slack)
    found = found.groupBy("id", "mark", "t", "grid", cell.alias("cell")).agg(
        F.bit_or("bits").alias("bits"), F.bit_or("phrase_bits").alias("phrase_bits"),
        F.min(F.when(F.col("phrase_bits") > 0, F.col("start"))).alias("start"))
    held = F.aggregate("shares", F.struct(F.lit(0.0).alias("sum"), F.lit(1).cast("bigint").alias("bit")), lambda s, x: F.struct(
        (s["sum"] + F.when(F.col("bits").bitwiseAND(s["bit"]) != 0, x).otherwise(0.0)).alias("sum"),
        F.shiftleft(s["bit"], 1).alias("bit")), lambda s: F.least(s["sum"], F.lit(1.0)))
    found = found.join(small(index.totals), "t").withColumn("share", held)
    found = found.filter((F.col("phrase_bits") == F.expr("shiftleft(1L, size(phrases)) - 1")) & (F.col("share") >= share))
    found = found.groupBy("id", "mark", "label", "start").agg(F.max("words").alias("words"), F.max("share").alias("share"))
    matched = found.groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.struct("label", "start", "words", "share"))).alias("matches"))

    def stands(label: str, phrase: str) -> Column:
        own = F.filter("standing", lambda h: h["phrase"] == phrase)
        return F.transform(own, lambda h: F.struct(F.lit(label).alias("label"), h["at"].cast("bigint").alias("start")))

    base = seen.select("id", "mark", "n_words", F.sort_array(F.concat(*[stands(k, p) for k, p in phrases.items()])).alias("places"))
    joined = base.alias("b").join(matched.alias("m"), F.col("b.id").eqNullSafe(F.col("m.id")) & (F.col("b.mark") == F.col("m.mark")), "left")
    return joined.select("b.id", "n_words", "places", F.coalesce("matches", F.array().cast(matched.schema["matches"].dataType)).alias("matches"))


def labels_of(*arrays: str) -> Column:
    """Distinct labels of arrays of structs, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.col(f"{a}.label") for a in arrays]))), ",")
