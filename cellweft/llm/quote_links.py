"""Chat formatting: quotations linked to the messages they come from.

A line's quote level is the number of ``>`` marks that lead it. Runs of lines at one level are
passages; a passage and each of its lines are normalised (marks off, white space to one space,
lower case) and hashed. Own passages and lines of a message are indexed by (conversation,
hash); a quoted one is linked to the latest earlier message that holds the hash as its
own. A message's parent is the earlier message with the lowest quote level, then the
most linked lines, then the highest turn; without any link it is the message before.

A message that answers the one before continues its branch; any other parent starts a branch there.
``reply_path`` holds the anchors and starts of the branches that lead to a message, then
its turn; sorted by it, a conversation runs reply after reply, every parent before its answers.
Quoted lines, and a line that only announces a quotation, are taken out of the text.

"Latest earlier" is looked up in chunks of turns, so a conversation or a line that holds a third
of all rows is dealt to many tasks; only one row per chunk is carried on. The result is sorted
by range, which splits a large conversation as well.

Defined results: a null or empty text has an empty clean text. A null conversation is one
of its own. A message with a null turn has no parent, is none, and its path is empty. Rows that repeat a
turn are separate messages at the same place.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from cellweft.llm.common import tune, written

CHUNK = 1024
_MARKS = re.compile(r"^(?:[ \t]*>)+[ \t]?")
_ANNOUNCES = re.compile(r"^\s*\S.{0,200}\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$")


def level_of(line: str) -> tuple[int, str]:
    m = _MARKS.match(line)
    return (m.group().count(">"), line[m.end():]) if m else (0, line)


def passages(text: str | None) -> list[tuple[int, list[str]]]:
    """(level, lines) of every run of lines at one level; a blank own line ends a run."""
    found: list[tuple[int, list[str]]] = []
    open_run = False
    for line in (text or "").split("\n"):
        level, rest = level_of(line)
        if not rest.strip():
            open_run = open_run and level > 0
            continue
        if open_run and found[-1][0] == level:
            found[-1][1].append(rest)
        else:
            found.append((level, [rest]))
        open_run = True
    return found


def normal(lines: list[str]) -> str:
    return " ".join(" ".join(lines).split()).lower()


def hash_of(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def clean_text(text: str | None) -> str:
    """Own lines; quotations and the lines that announce them are gone, blank edges too."""
    lines = [(*level_of(line), line) for line in (text or "").split("\n")]
    kept = []
    for k, (level, _, line) in enumerate(lines):
        follows = next((x[0] for x in lines[k + 1:] if x[0] or x[1].strip()), 0)
        if level == 0 and not (follows and _ANNOUNCES.match(line)):
            kept.append(line)
    return "\n".join(kept).strip()


def own_and_quoted(text: str | None) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Hashes of own passages and lines; (level, hash, lines) of quoted ones."""
    own, quoted = set(), []
    for level, lines in passages(text):
        parts = [(normal([x]), 1) for x in lines]
        if len(lines) > 1:
            parts.append((normal(lines), len(lines)))
        if level:
            quoted += [(level, hash_of(part), n) for part, n in parts]
        else:
            own.update(hash_of(part) for part, _ in parts)
    return sorted(own), quoted


def latest(asked: DataFrame, events: DataFrame, keys: list[str], inclusive: bool = False) -> DataFrame:
    """``asked`` with ``found``: the highest ``turn`` of ``events`` with equal keys before (or at) its own.

    Within a chunk of turns a window looks back; what lies in earlier chunks comes as one row per chunk.
    """
    columns = asked.columns
    rank = 1 if inclusive else -1
    both = asked.withColumn("event", F.lit(None).cast("long")).withColumn("rank", F.lit(0)).unionByName(
        events.select(*keys, "turn", F.col("turn").alias("event"), F.lit(-rank).alias("rank")), allowMissingColumns=True)
    both = both.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*keys, "chunk").agg(F.max("event").alias("top")).withColumn("carried", F.max("top").over(before))
    carried = carried.filter(F.col("carried").isNotNull()).select(*keys, "chunk", "carried")
    within = Window.partitionBy(*keys, "chunk").orderBy("turn", "rank").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("near", F.max("event").over(within)).filter(F.col("event").isNull())
    told = seen.join(carried, [*keys, "chunk"], "left")
    return told.select(*columns, F.coalesce("near", "carried").alias("found"))


def link_quotations(messages: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv, turn, role, text, parent_turn, linked_by, reply_path), one row per message, in reply order."""
    tune(messages.sparkSession)

    def parse(batches):
        for pdf in batches:
            both = [own_and_quoted(t) for t in pdf["text"]]
            pdf["text"] = [clean_text(t) for t in pdf["text"]]
            pdf["own"] = pd.Series([own for own, _ in both], index=pdf.index, dtype=object)
            pdf["quoted"] = pd.Series([[{"level": a, "hash": h, "lines": n} for a, h, n in quoted] for _, quoted in both],
                                      index=pdf.index, dtype=object)
            yield pdf

    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                           F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.withColumn("ckey", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("")))
    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    parsed = rows.mapInPandas(parse, kinds + ", own array<long>, quoted array<struct<level:int,hash:long,lines:int>>")
    parsed = written(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed")
    placed = parsed.filter(F.col("turn").isNotNull())

    own = placed.select("ckey", "turn", F.explode("own").alias("hash")).distinct()
    asked = placed.select("row", "ckey", "turn", F.explode("quoted").alias("q")).select("row", "ckey", "turn", "q.*").distinct()
    matched = latest(asked, own, ["ckey", "hash"]).filter(F.col("found").isNotNull())
    rated = matched.groupBy("row", "level", F.col("found").alias("parent")).agg(F.sum("lines").alias("lines"))
    chosen = rated.groupBy("row").agg(F.max(F.struct(-F.col("level"), F.col("lines"), F.col("parent"))).getField("parent").alias("parent"))

    turns = placed.select("ckey", "turn").distinct()
    before = latest(placed.select("row", "ckey", "turn"), turns, ["ckey"]).withColumnRenamed("found", "previous")
    linked = written(before.join(chosen, "row", "left"), "linked")
    starts = linked.filter(F.col("previous").isNull() | (F.col("parent") != F.col("previous")))
    starts = starts.groupBy("ckey", "turn").agg(F.min("parent").alias("anchor"))
    marks = starts.select("ckey", "turn")
    told = latest(linked, marks, ["ckey"], inclusive=True).withColumnRenamed("found", "branch")

    paths = branch_paths(starts, marks)
    told = told.join(paths.withColumnRenamed("start", "branch"), ["ckey", "branch"], "left")
    extra = told.select("row", F.coalesce("parent", "previous").alias("parent_turn"),
                        F.when(F.col("parent").isNotNull(), "quote").when(F.col("previous").isNotNull(), "previous").alias("linked_by"),
                        F.concat("path", F.array("turn")).alias("reply_path"))
    none = F.array().cast("array<long>")
    out = parsed.select("row", "conv", "turn", "role", "text").join(extra, "row", "left").drop("row")
    return out.withColumn("reply_path", F.coalesce("reply_path", none)).orderBy("conv", "reply_path", "turn")


def branch_paths(starts: DataFrame, marks: DataFrame) -> DataFrame:
    """(ckey, start, path): anchors and starts from the first branch to each, one nesting level a round."""
    empty = F.array().cast("array<long>")
    roots = starts.filter(F.col("anchor").isNull()).select("ckey", F.col("turn").alias("start"), empty.alias("path"))
    done = roots
    rest = starts.filter(F.col("anchor").isNotNull()).select("ckey", F.col("turn").alias("start"), F.col("anchor").alias("turn"))
    rest = written(latest(rest, marks, ["ckey"], inclusive=True).withColumnRenamed("found", "up"), "branches")
    front = roots
    while True:
        upper = front.select(F.col("ckey").alias("k"), F.col("start").alias("s"), "path")
        front = written(rest.join(upper, (F.col("ckey") == F.col("k")) & (F.col("up") == F.col("s"))).select(
            "ckey", "start", F.concat("path", F.array("turn", "start")).alias("path")), "paths")
        if front.isEmpty():
            return done
        done = done.unionByName(front)
