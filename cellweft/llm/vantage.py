"""Nearest neighbours by inner product: a vantage-point tree per shard.

Vectors get one more component, ``sqrt(m**2 - |x|**2)`` with ``m`` the longest norm of
their dimension, and queries a zero. All vectors then have length ``m`` and the
order by distance is the order by inner product, so distances bound what a subtree can
hold: with a query at distance ``d`` of the vantage point and members between ``low``
and ``high``, none is nearer than ``max(low - d, d - high)``. A subtree is left
out if that bound times ``factor`` exceeds the distance of the k-th best so far;
``factor`` 1 is exact, a larger one prunes more.

Rows are dealt to shards by a hash of the row; a shard's tree is built once by one task and stored
as one row. Queries go in blocks to all shards, which is what a stated query set
against all rows means; a task holds one shard and one block. Tree leaves are scored by a
matrix product; whatever may be among the best is scored again, component after
component in double precision on the original vectors, so scores don't depend on the plan.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do rows with a null id. Only vectors of equal dimension are compared. Repeated ids are
separate rows; a query meets all rows but its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cellweft.llm.common import by_groups, fields, tune, written

LEAF = 512
SLACK = 1e-9
#: Distances are roots of differences, so what rounds by SLACK in a square rounds by its root near 0.
REACH_SLACK = math.sqrt(SLACK)


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes): nodes are (start, middle, end, low1, high1, low2, high2, first, second), leaves have middle -1.

    The vantage point of a node stands at ``start``; its inner half is [start + 1, middle).
    """
    order = np.arange(len(points))
    nodes: list[list[float]] = []

    def grow(a: int, b: int) -> int:
        at = len(nodes)
        nodes.append([a, -1, b, 0, 0, 0, 0, -1, -1])
        if b - a <= LEAF:
            return at
        own = order[a:b]
        far = int(np.argmax(((points[own] - points[own].mean(0)) ** 2).sum(1)))
        own[[0, far]] = own[[far, 0]]
        apart = np.sqrt(((points[own[1:]] - points[own[0]]) ** 2).sum(1))
        half = len(apart) // 2
        rank = np.argsort(apart, kind="stable")
        own[1:] = own[1:][rank]
        apart = apart[rank]
        middle = a + 1 + half
        first, second = grow(a + 1, middle), grow(middle, b)
        nodes[at] = [a, middle, b, apart[0], apart[half - 1], apart[half], apart[-1], first, second]
        return at

    grow(0, len(points))
    return order, np.array(nodes, float)


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, added up component after component."""
    total = np.zeros(len(left))
    for d in range(left.shape[1]):
        total += left[:, d] * right[:, d]
    return total


class Search:
    """All queries of one block against one shard."""

    def __init__(self, vectors, extra, rows, ids, nodes, queries, query_rows, longest, k, factor):
        self.vectors, self.extra, self.rows, self.ids, self.nodes = vectors, extra, rows, ids, nodes
        self.queries, self.query_rows, self.k, self.factor = queries, query_rows, k, factor
        self.base = (queries**2).sum(1) + longest**2
        self.scale = math.sqrt(float(self.base.max(initial=0.0))) + 1.0
        self.best = np.full((len(queries), k), -np.inf)
        self.who = np.full((len(queries), k), -1, np.int64)

    def reach(self, active):
        """Distance of the k-th best so far."""
        worst = self.best[active, -1]
        return np.where(np.isfinite(worst), np.sqrt(np.maximum(self.base[active] - 2 * np.maximum(worst, -1e300), 0)), np.inf)

    def offer(self, active, a, b):
        """Score the members [a, b) for the active queries and keep the best."""
        rough = self.queries[active] @ self.vectors[a:b].T
        rough[self.rows[a:b][None, :] == self.query_rows[active][:, None]] = -np.inf
        slack = SLACK * self.scale**2
        bar = self.best[active, -1]
        if b - a > self.k:
            bar = np.maximum(bar, np.partition(rough, b - a - self.k, axis=1)[:, b - a - self.k])
        q, c = np.nonzero((rough >= bar[:, None] - slack) & np.isfinite(rough))
        if not len(q):
            return
        score = exact_scores(self.queries[active[q]], self.vectors[a + c])
        touched, first = np.unique(q, return_index=True)
        for t, lo, hi in zip(touched, first, [*first[1:], len(q)]):
            row = active[t]
            s = np.concatenate([self.best[row], score[lo:hi]])
            w = np.concatenate([self.who[row], a + c[lo:hi]])
            names = np.where(w >= 0, self.ids[w], np.iinfo(np.int64).max)
            keep = np.lexsort((names, -s))[:self.k]
            self.best[row], self.who[row] = s[keep], w[keep]

    def visit(self, node, active):
        if not len(active):
            return
        a, middle, b, low1, high1, low2, high2, first, second = self.nodes[node]
        a, middle, b = int(a), int(middle), int(b)
        if middle < 0:
            self.offer(active, a, b)
            return
        self.offer(active, a, a + 1)
        apart = self.base[active] - 2 * (self.queries[active] @ self.vectors[a])
        apart = np.sqrt(np.maximum(apart, 0))
        bounds = [np.maximum(low - apart, apart - high) for low, high in ((low1, high1), (low2, high2))]
        inner = bounds[0] <= bounds[1]
        children = (int(first), int(second))

        def go(side, which):
            if which.any():
                near = self.factor * bounds[side][which] <= self.reach(active[which]) + REACH_SLACK * self.scale
                self.visit(children[side], active[which][near])

        go(0, inner)
        go(1, ~inner)
        go(1, inner)
        go(0, ~inner)


def index_shards(rows: DataFrame, shard_rows: int) -> DataFrame:
    """One row per (dim, shard): packed vectors, row numbers, ids and tree."""
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("longest"))
    told = rows.join(sizes, "dim")
    shards = F.greatest(F.ceil(F.col("n") / shard_rows), F.lit(1))
    told = told.withColumn("shard", F.pmod(F.xxhash64("row"), shards))

    def build(key, pdf):
        pdf = pdf.sort_values("row")
        vectors = np.array(pdf["vector"].tolist(), float).reshape(len(pdf), -1)
        longest = float(pdf["longest"].iloc[0])
        extra = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        order, nodes = build_tree(np.column_stack([vectors, extra]))
        packed = [x.tobytes() for x in (vectors[order], extra[order], pdf["row"].to_numpy(np.int64)[order],
                                        pdf["id"].to_numpy(np.int64)[order], nodes)]
        return pd.DataFrame([(*key, longest, *packed)],
                            columns=["dim", "shard", "longest", "vectors", "extra", "rows", "ids", "nodes"])

    return written(told.select("dim", "shard", "row", "id", "vector", "longest").groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard long, longest double, vectors binary, extra binary, rows binary, ids binary, nodes binary"),
        "trees")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, shard_rows: int = 4096,
            query_rows: int = 2048, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest of every row for which ``is_query`` (over ``id``) holds."""
    tune(vectors.sparkSession)
    vector = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & usable(vector))
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    rows = written(rows.select("id", "vector", F.size(vector).alias("dim"), norm.alias("norm"),
                               F.monotonically_increasing_id().alias("row")), "vectors")
    trees = index_shards(rows, shard_rows)
    queries = rows.filter(is_query)
    counts = queries.groupBy("dim").agg(F.greatest(F.ceil(F.count("*") / query_rows), F.lit(1)).alias("blocks"))
    shards = trees.groupBy("dim").agg(F.max("shard").alias("last"))
    asked = queries.join(counts, "dim").join(shards, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("shard"),
        F.pmod(F.xxhash64("row", F.lit(1)), "blocks").alias("block"), F.col("row"), "id", "vector")
    offered = trees.join(counts, "dim").select(
        "dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        F.lit(-1).cast("long").alias("row"), "longest", "vectors", "rows", "ids", "extra", "nodes")
    both = offered.unionByName(asked, allowMissingColumns=True)

    def run(key, group):
        if group["row"][0] != -1 or len(group["row"]) < 2:
            return []
        dim = int(key[0])
        packed = {c: np.frombuffer(group[c][0], t) for c, t in
                  (("vectors", float), ("extra", float), ("rows", np.int64), ("ids", np.int64), ("nodes", float))}
        asked = np.array(group["vector"][1:].tolist(), float).reshape(-1, dim)
        numbers = group["row"][1:].astype(np.int64)
        search = Search(packed["vectors"].reshape(-1, dim), packed["extra"], packed["rows"], packed["ids"],
                        packed["nodes"].reshape(-1, 9), asked, numbers, float(group["longest"][0]), k, factor)
        search.visit(0, np.arange(len(asked)))
        q, place = np.nonzero(search.who >= 0)
        names = group["id"][1:].astype(np.int64)
        return list(zip(numbers[q].tolist(), names[q].tolist(), packed["ids"][search.who[q, place]].tolist(),
                        search.best[q, place].tolist()))

    found = by_groups(both, ["dim", "shard", "block"], run,
                      fields(query_row="long", query_id="long", id="long", score="double"), order=["row"])
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")
