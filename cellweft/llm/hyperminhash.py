"""Near-duplicate groups by HyperMinHash.

A document's set is its distinct 5-word shingles. One hash per shingle picks one of
128 buckets (top 7 bits); the smallest remaining 57 bits of a bucket are kept as a
16-bit register: the number of leading zeros (6 bits) and the 10 bits after the first
one. Documents with equal sets are one node from the start.

Candidates: four neighbouring registers are a band, 32 bands a document. Two sets of
similarity 0.75 agree in a band with odds of 0.316 or more, so they miss all 32 with odds
of about 5 in a million. Sets of few shingles have empty registers; a band agrees
then too, unless a shingle that only one set has falls into it.

Estimate: registers that are equal, less the expected number of chance collisions, over
registers that are filled in either set. A pair is verified unless that lies more than
``MARGIN`` standard deviations under the threshold. Verification counts the full sets.

No step emits all pairs of a band bucket:

1. In every bucket the node whose buckets are largest in sum (near the middle of its
   group) is compared with the others: at most 32 pairs a node. Verified links give components.
2. Buckets of two nodes, and those that lie in one component, are done. In the others, pairs across
   components are estimated inside tasks, in blocks of ``BLOCK`` nodes. A task emits, per node, the
   partners that remain; each pair is emitted only by the first band in which it
   agrees. The sets are then sent to the blocks that need them and compared there, and
   only links that join something new within the task leave it.

Components of all links give the smallest document id reachable.

Defined results: null text, or text without words, has an empty set, is linked with nothing
and has its own id. A null id takes part; it never is the smallest unless a whole component has
none. ``kept`` compares ids null-safe. Rows that repeat an id are separate rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from cellweft.llm.common import by_groups, fields, small_side, tune, written
from cellweft.llm.components import components
from cellweft.llm.words import mix, shingle_set

REGISTERS = 128
BUCKET_BITS = 7
MANTISSA = 10
ROWS = 4
BANDS = REGISTERS // ROWS
EMPTY = 0xFFFF
MARGIN = 4.0
BLOCK = 512
#: Fixed value: the constant of the published approximation of expected collisions.
COLLISION = 0.169919487159739093975315012348630288992889

_STARTS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
_INDEX = np.arange(REGISTERS, dtype=np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The 128 registers of a sorted shingle set."""
    if not len(shingles):
        return np.full(REGISTERS, EMPTY, np.uint16)
    at = np.searchsorted(shingles, _STARTS)
    least = shingles[np.minimum(at, len(shingles) - 1)]
    filled = (at < len(shingles)) & ((least >> np.uint64(64 - BUCKET_BITS)) == _INDEX)
    rest = (least << np.uint64(BUCKET_BITS)) | np.uint64(1 << (BUCKET_BITS - 1))
    zeros = np.zeros(REGISTERS, np.uint64)
    value = rest.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = (value >> np.uint64(64 - step)) == 0
        zeros[low] += np.uint64(step)
        value[low] <<= np.uint64(step)
    mantissa = (value >> np.uint64(63 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return np.where(filled, (zeros << np.uint64(MANTISSA)) | mantissa, EMPTY).astype(np.uint16)


def band_keys(regs: np.ndarray) -> list[tuple[int, int]]:
    """(band, 64-bit key) of bands with a filled register."""
    bands = regs.reshape(BANDS, ROWS)
    packed = np.ascontiguousarray(bands).view(np.uint64).ravel()
    keys = mix(packed ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    used = np.flatnonzero((bands != EMPTY).any(1))
    return list(zip(used.tolist(), keys[used].view(np.int64).tolist()))


def estimate(one: np.ndarray, many: np.ndarray, size: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, number of filled registers) of one register row against many, collisions taken off."""
    filled = (many != EMPTY) | (one != EMPTY)
    n = np.maximum(filled.sum(1), 1)
    equal = ((many == one) & filled).sum(1)
    ratio = np.maximum(size, sizes) / np.maximum(np.minimum(size, sizes), 1)
    chance = COLLISION * n / 2.0**MANTISSA * 4.0 * ratio / (1.0 + ratio) ** 2
    return np.maximum(equal - chance, 0.0) / n, n


def worth_verifying(one, many, size, sizes, share: float) -> np.ndarray:
    """False only where sizes rule a link out, or the estimate lies far under ``share``."""
    found, n = estimate(one, many, size, sizes)
    slack = MARGIN * np.sqrt(share * (1 - share) / n) + 1.0 / n
    possible = np.minimum(size, sizes) >= share * np.maximum(size, sizes) - 1e-9
    return possible & (found >= share - slack)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, counted on the full sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return bool(len(a)) and 100 * both >= percent * (len(a) + len(b) - both)


def sketch(docs: DataFrame, id_col="doc_id", text_col="text", width: int = 5) -> DataFrame:
    """One row per document, in a written copy: id, node (hash of the set; null if empty), n_shingles, regs."""

    def run(batches):
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                found = shingle_set(text, width)
                rows.append((xxhash.xxh3_128_digest(found.tobytes()), len(found), registers(found).tobytes())
                            if len(found) else (None, 0, None))
            out = pd.DataFrame(rows, columns=["node", "n_shingles", "regs"], index=pdf.index)
            yield pd.concat([pdf[["id"]], out], axis=1)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return written(rows.mapInPandas(run, f"id {kind}, node binary, n_shingles long, regs binary"), "sketches")


def band_entries(nodes: DataFrame) -> DataFrame:
    """(band, key, node) of every band bucket with two or more nodes, and its size."""

    def run(batches):
        for pdf in batches:
            found = [band_keys(np.frombuffer(regs, np.uint16)) for regs in pdf["regs"]]
            counts = [len(x) for x in found]
            flat = [x for keys in found for x in keys]
            yield pd.DataFrame({"node": np.repeat(pdf["node"].to_numpy(), counts),
                                "band": np.array([b for b, _ in flat], np.int32),
                                "key": np.array([k for _, k in flat], np.int64)})

    entries = written(nodes.select("node", "regs").mapInPandas(run, "node binary, band int, key long"), "bands")
    crowded = entries.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    return written(entries.join(crowded, ["band", "key"]), "buckets")


def star_pairs(entries: DataFrame) -> DataFrame:
    """Distinct (a, b): a node and the best connected node of one of its buckets."""
    reach = entries.groupBy("node").agg(F.sum("size").alias("reach"))
    rated = entries.join(reach, "node")
    hubs = rated.groupBy("band", "key").agg(F.max(F.struct("reach", "node")).getField("node").alias("hub"))
    pairs = entries.join(hubs, ["band", "key"]).filter("node <> hub")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def promising(pairs: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """Pairs whose estimate allows a link."""
    side = nodes.select("node", "regs", "n_shingles")
    told = pairs.join(side.toDF("a", "regs_a", "size_a"), "a").join(side.toDF("b", "regs_b", "size_b"), "b")

    def run(batches):
        for pdf in batches:
            keep = [bool(worth_verifying(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)[None], m,
                                         np.array([n]), share)[0])
                    for x, y, m, n in zip(pdf["regs_a"], pdf["regs_b"], pdf["size_a"], pdf["size_b"])]
            yield pdf.loc[keep, ["a", "b"]]

    return written(told.mapInPandas(run, "a binary, b binary"), "promising")


def full_sets(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, id_col, text_col, width: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the text of one document of each."""
    chosen = nodes.join(wanted, "node", "left_semi").select("first_id", "node")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(chosen.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("first_id"))).select("node", "text")

    def run(batches):
        for pdf in batches:
            rows = []
            for node, text in zip(pdf["node"], pdf["text"]):
                found = shingle_set(text, width)
                if xxhash.xxh3_128_digest(found.tobytes()) == bytes(node):
                    rows.append((node, found.tobytes()))
            yield pd.DataFrame(rows, columns=["node", "shingles"])

    return written(joined.mapInPandas(run, "node binary, shingles binary").dropDuplicates(["node"]), "sets")


def verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    told = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def run(batches):
        for pdf in batches:
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for x, y in zip(pdf["set_a"], pdf["set_b"])]
            yield pdf.loc[keep, ["a", "b"]]

    return written(told.mapInPandas(run, "a binary, b binary"), "verified")


def open_blocks(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of buckets that hold two or more components, dealt to pairs of blocks.

    A bucket of n nodes has ceil(n / BLOCK) blocks, dealt by a hash of the node; the group
    (band, key, i, j) with i <= j holds the nodes of blocks i and j.
    """
    told = entries.filter("size > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = told.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    told = told.join(mixed.select("band", "key"), ["band", "key"])
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    told = told.withColumns({"blocks": count, "block": F.pmod(F.xxhash64("node"), count).cast("int")})
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    told = told.select("band", "key", "node", "root", "block", other)
    return told.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")


def near_partners(blocks: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """(band, key, i, j, node, partners): pairs across components that agree first in this band.

    Every node of such a pair has one row in its group; the list names each pair once.
    """
    told = blocks.join(nodes.select("node", "regs", "n_shingles"), "node")

    def run(key, rows):
        band, _, i, j = key
        keep = np.unique([bytes(n) for n in rows["node"]], return_index=True)[1] if i == j else slice(None)
        names, sizes, block = rows["node"][keep], rows["n_shingles"][keep], rows["block"][keep]
        roots = np.unique([bytes(r).hex() for r in rows["root"][keep]], return_inverse=True)[1]
        if len(names) < 2 or not roots.any():
            return []
        regs = np.frombuffer(b"".join(rows["regs"][keep]), np.uint16).reshape(len(names), REGISTERS)
        words = regs.view(np.uint64)
        filled = (regs.reshape(len(regs), BANDS, ROWS) != EMPTY).any(2)
        partners: dict[int, list] = {}
        for k in range(len(names)):
            if i == j:
                others = np.arange(k + 1, len(names))
            else:
                others = np.flatnonzero(block == j) if block[k] == i else np.empty(0, np.int64)
            others = others[roots[others] != roots[k]]
            if len(others) and band:
                earlier = ((words[others, :band] == words[k, :band]) & filled[k, :band]).any(1)
                others = others[~earlier]
            if len(others):
                others = others[worth_verifying(regs[k], regs[others], sizes[k], sizes[others], share)]
            if len(others):
                partners.setdefault(k, []).extend(names[others])
                for other in others.tolist():
                    partners.setdefault(other, [])
        return [(*key, names[k], found) for k, found in partners.items()]

    schema = fields(band="int", key="long", i="int", j="int", node="binary", partners="array<binary>")
    return written(by_groups(told, ["band", "key", "i", "j"], run, schema), "partners")


def verify_blocks(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links of each group, without those that join what the group has joined already."""
    group = ["band", "key", "i", "j"]
    none = F.lit(None)
    both = near.select(*group, "node").join(sets, "node").select(*group, "node", "shingles", none.cast("array<binary>").alias("partners"))
    both = both.unionByName(near.filter(F.size("partners") > 0).select(
        *group, "node", none.cast("binary").alias("shingles"), "partners"))

    def run(key, rows):
        full = {bytes(n): np.frombuffer(s, np.uint64) for n, s in zip(rows["node"], rows["shingles"]) if s is not None}
        root = {n: n for n in full}

        def find(n):
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        links = []
        for node, partners in zip(rows["node"], rows["partners"]):
            node = bytes(node)
            for partner in map(bytes, [] if partners is None else partners):
                if find(node) != find(partner) and linked(full[node], full[partner], percent):
                    root[find(node)] = find(partner)
                    links.append((node, partner))
        return links

    return by_groups(both, group, run, fields(a="binary", b="binary"), order=["node"])


def duplicate_groups(docs: DataFrame, id_col="doc_id", text_col="text", width: int = 5, percent: int = 75) -> DataFrame:
    """(id, node, n_shingles, root, least), one row per document; no root without words."""
    tune(docs.sparkSession)
    share = percent / 100.0
    rows = sketch(docs, id_col, text_col, width)
    nodes = written(rows.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")), "nodes")
    entries = band_entries(nodes)

    stars = promising(star_pairs(entries), nodes, share)
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    links = verify_pairs(stars, full_sets(docs, ends(stars), nodes, id_col, text_col, width), percent)
    roots = written(components(links), "roots")

    near = near_partners(open_blocks(entries, roots), nodes, share)
    more = verify_blocks(near, full_sets(docs, near.select("node").distinct(), nodes, id_col, text_col, width), percent)
    links = written(links.unionByName(more), "links")
    roots = written(components(links), "roots")

    told = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(
        F.min("first_id").alias("least"))
    return told.join(smallest, "root", "left").select("id", "node", "n_shingles", "root", "least")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", width: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per document."""
    told = duplicate_groups(docs, id_col, text_col, width, percent)
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least"))
    return told.select("id", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def one_per_group(docs: DataFrame, id_col="doc_id", text_col="text", width: int = 5, percent: int = 75) -> DataFrame:
    """One document of each group, with its own columns: that of the smallest id.

    Documents without words all stay. Rows meet their group's choice by id, so a large
    group of copies is spread over all tasks, and texts are neither sorted nor read twice.
    Only rows that repeat an id need their set again to be told apart.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("i"), F.col(c).cast("string")), F.lit(""))
    told = written(duplicate_groups(docs, id_col, text_col, width, percent).withColumn("name", named("id")), "groups")
    chosen = told.filter(F.col("node").isNotNull() & F.col("id").eqNullSafe(F.col("least")))
    chosen = chosen.groupBy("root").agg(F.min(F.struct("name", "node")).alias("x")).select("x.*")
    wanted = chosen.unionByName(told.filter(F.col("node").isNull()).select("name", "node"))
    repeated = told.groupBy("name").agg(F.count("*").alias("copies")).filter("copies > 1")
    wanted = written(wanted.join(repeated, "name", "left"), "wanted")
    names = docs.columns
    inner = {c: f"c{k}" for k, c in enumerate(names)}
    rows = docs.toDF(*inner.values()).withColumn("name", named(inner[id_col]))
    text = inner[text_col]

    single = wanted.filter(F.col("copies").isNull()).select("name")
    kept = rows.join(single.hint("shuffle_hash"), "name", "left_semi").select(*inner.values())
    several = wanted.filter("copies > 1")
    if several.isEmpty():
        return kept.toDF(*names)

    def mark(batches):
        for pdf in batches:
            sets = [shingle_set(t, width) for t in pdf[text]]
            yield pdf.assign(node=[xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets])

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    same = small_side(several.select("name").distinct(), "repeated")
    marked = rows.join(same, "name", "left_semi").select(*rows.columns).mapInPandas(mark, f"{kinds}, node binary")
    one = marked.join(several.select("name", "node"), ["name", "node"]).dropDuplicates(["name", "node"])
    empty = marked.filter(F.col("node").isNull())
    return kept.unionByName(one.select(*inner.values())).unionByName(empty.select(*inner.values())).toDF(*names)
