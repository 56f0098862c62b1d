"""Secret scan: base patterns, and how many owners share each candidate.

Every candidate value is hashed (SHA-256, first 16 bytes). Over the whole corpus the hash is
counted by distinct repositories and distinct owners, which gives its ``spread``:

- ``wide``: ``shared_from`` or more owners and as many repositories. A widely copied example.
- ``shared``: as many owners, but fewer repositories. A credential that the people of few repositories share.
- ``owner``: fewer owners, in however many repositories. A credential of its owner.

A value that looks random and is not ``wide`` is live. Beside the base spans, candidates of the wider ``loose`` pattern
become spans of kind ``owned`` if their value is live and they overlap no base span.

Counting takes two steps: distinct (hash, owner) and (hash, repository) rows, then hashes.
Each adds up within its tasks first, so a value that sits in a third of all rows
is a handful of partial rows. The way back joins rows to unique hashes, a join whose
large partitions Spark splits.

Defined results: a null or empty text has no spans. A null owner or repository counts as one
of its own. Repeated rows are separate rows, of one repository if their ids agree.
"""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cellweft.llm.common import tune, written

#: The patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_-])")


def base_spans(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) by start, then kind as listed; code points, end exclusive."""
    if not text:
        return []
    found = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return [(start, end, KINDS[kind], value) for start, kind, end, value in sorted(found)]


def looks_random(value: str) -> bool:
    """At least 3 bits a character, with a letter and a digit."""
    n = len(value)
    if not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
        return False
    return -sum(k / n * math.log2(k / n) for k in map(value.count, set(value))) >= 3.0


def loose_spans(text: str | None, taken) -> list[tuple[int, int, str, str]]:
    """Long random-looking tokens that overlap none of the spans in ``taken``."""
    if not text:
        return []
    found = []
    for m in LOOSE.finditer(text):
        if looks_random(m.group()) and not any(start < m.end() and m.start() < end for start, end, *_ in taken):
            found.append((m.start(), m.end(), "owned", m.group()))
    return found


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, *_ in spans)


def key_of(value: str) -> bytes:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[:16]


CANDIDATE = "struct<start:int,end:int,kind:string,key:binary,random:boolean>"


def find_candidates(docs: DataFrame, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """The given columns with ``found`` (all candidates), ``owner``, ``repo`` and a row number, in a written copy."""

    def scan(batches):
        for pdf in batches:
            found = []
            for text in pdf[text_col]:
                base = base_spans(text)
                found.append([{"start": a, "end": b, "kind": kind, "key": key_of(value), "random": looks_random(value)}
                              for a, b, kind, value in base + loose_spans(text, base)])
            yield pdf.assign(found=pd.Series(found, index=pdf.index, dtype=object))

    kinds = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    found = docs.mapInPandas(scan, f"{kinds}, found array<{CANDIDATE}>")
    return found.withColumns({"owner": F.col(owner_col).cast("string"), "repo": F.col(repo_col).cast("string"),
                              "row": F.monotonically_increasing_id()})


def ownership(found: DataFrame) -> DataFrame:
    """(key, owners, repos): distinct owners and distinct repositories of every candidate value."""
    single = found.select("owner", "repo", F.explode("found.key").alias("key"))
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("name")) for side in ("owner", "repo")])
    apart = single.select("key", F.explode(sides).alias("by")).select("key", "by.*").distinct()
    return apart.groupBy("key").agg(F.count_if(F.col("side") == "owner").alias("owners"), F.count_if(F.col("side") == "repo").alias("repos"))


SPAN = "struct<start:int,end:int,kind:string,live:boolean,spread:string,owners:bigint,repos:bigint>"


def judge_spans(found: DataFrame, shared_from: int = 3) -> DataFrame:
    """(row, spans) from (row, owner, repo, found): candidates with owners, repositories, ``spread`` and ``live``."""
    single = found.select("row", F.explode("found").alias("c")).select("row", "c.*")
    told = single.join(ownership(found), "key", "left")
    many = F.col("owners") >= shared_from
    spread = F.when(many & (F.col("repos") >= shared_from), "wide").when(many, "shared").otherwise("owner")
    live = F.col("random") & (spread != "wide")
    span = F.struct("start", "end", "kind", live.alias("live"), spread.alias("spread"), "owners", "repos")
    kept = told.filter((F.col("kind") != "owned") | live)
    return kept.groupBy("row").agg(F.collect_list(span).alias("spans"))


def scan_secrets(docs: DataFrame, shared_from: int = 3, id_col="doc_id", text_col="text", owner_col="source",
                 repo_col="doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_live, n_example, n_shared, base, spans), one row per document.

    ``n_live`` counts live spans, ``n_example`` those of widely copied values, ``n_shared`` those of values that
    many owners hold in few repositories.

    ``base`` and ``spans`` are arrays ordered by start and kind as listed, ``owned`` last.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(owner_col).alias("of"),
                       F.col(repo_col).alias("at"))
    found = written(find_candidates(rows, "text", "of", "at").drop("text", "of", "at"), "secrets")
    judged = judge_spans(found, shared_from)
    both = found.select("row", "id").join(judged, "row", "left")
    rank = F.create_map(*[F.lit(x) for pair in zip((*KINDS, "owned"), range(4)) for x in pair])
    spans = F.array_sort(F.transform(
        F.coalesce("spans", F.array().cast(f"array<{SPAN}>")),
        lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"),
                           s["kind"].alias("kind"), s["live"].alias("live"), s["spread"].alias("spread"),
                           s["owners"].alias("owners"), s["repos"].alias("repos"))))
    both = both.select("id", spans.alias("spans"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return both.select(
        "id", *[F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        *[F.size(F.filter("spans", _of_spread(spread))).cast("long").alias(name)
          for name, spread in (("n_example", "wide"), ("n_shared", "shared"))],
        base.alias("base"), "spans")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _of_spread(spread: str):
    return lambda s: s["spread"] == spread


def mask(text: str, spans, mark: str = "[secret]") -> str:
    """The text with every (start, end) replaced; overlapping spans are one."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, shared_from: int = 3, text_col="text", owner_col="source", repo_col="doc_id",
                 size_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, with every span masked whose value is not widely copied.

    Values that ``shared_from`` owners and as many repositories hold stay. ``size_col``, if there, is set to the new length in code points.
    Only rows with a candidate are joined; the others never leave their partition.
    """
    tune(docs.sparkSession)
    names = docs.columns
    inner = {c: f"c{k}" for k, c in enumerate(names)}
    rows = docs.toDF(*inner.values())
    found = written(find_candidates(rows, inner[text_col], inner[owner_col], inner[repo_col]), "secrets")
    dirty = found.filter(F.size("found") > 0)
    bare = judge_spans(found.select("row", "owner", "repo", "found"), shared_from)
    hidden = F.transform(F.filter("spans", lambda s: s["spread"] != "wide"),
                         lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    told = dirty.select("row", *inner.values()).join(bare.select("row", hidden.alias("hidden")), "row", "left").drop("row")
    text = inner[text_col]

    def hide(batches):
        for pdf in batches:
            pdf[text] = [t if h is None or not len(h) else mask(t, [(x["start"], x["end"]) for x in h])
                         for t, h in zip(pdf[text], pdf.pop("hidden"))]
            yield pdf

    masked = told.mapInPandas(hide, rows.schema)
    if size_col in inner:
        masked = masked.withColumn(inner[size_col], F.length(text).cast(dict(rows.dtypes)[inner[size_col]]))
    return found.filter(F.size("found") == 0).select(*inner.values()).unionByName(masked).toDF(*names)


def span_text(spans: str) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
