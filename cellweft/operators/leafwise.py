"""Boosted trees grown best leaf first, with a limit on leaves, as Spark aggregates over binned inputs.

Inputs are cut to at most ``bins`` intervals once, and the binned rows are written. A tree takes one
aggregate per depth: sums of gradients and curvatures per (open leaf, input, bin), added up
within tasks first, so a pass shuffles at most leaves x inputs x bins rows whatever the table holds.
The best cut of a leaf depends on its own rows alone. So every leaf is cut down to the depth limit, and
then splits are taken greatest gain first until the tree has ``leaves`` leaves: the same tree as when
leaves are cut one by one. Rows with a missing input go to the side where the gain is greater.

Sums are whole numbers (gradients in steps of a power of two), so a tree does not depend on
how rows are dealt to tasks. Scoring is one column expression. Null, NaN and absent inputs are missing;
a column without values is never cut.
"""

from __future__ import annotations

import heapq
import math
import random
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweft.constants import LABEL
from cellweft.errors import DataError, MissingTableError
from cellweft.operators.evaluate import class_counts
from cellweft.operators.serve import aligned
from cellweft.session import scratch_path
from cellweft.sources.tables import write_table

# Training settings (fixed values): trees, rate, leaves, depth, rows per leaf, share of inputs per tree, seed.
TREES = 100
LEARNING_RATE = 0.05
LEAVES = 15
DEPTH = 5
MIN_ROWS_PER_LEAF = 5
INPUT_SHARE = 0.8
SEED = 42

BINS = 255
MIN_CURVATURE = 1e-3
# Trees after which the rows are written anew with their margin.
TREES_PER_COPY = 10
NODE_COLUMNS = ("tree int, node int, feature int, bin int, threshold double, missing_left boolean, left int, right int, "
                "gain double, value double, rows long, depth int")


@dataclass
class Node:
    """A leaf (``left`` is None) or a split of one tree."""

    grad: int
    curve: int
    rows: int
    depth: int
    cut: dict | None = None
    left: int | None = None
    right: int | None = None


@dataclass
class Forest:
    """Inputs, their margin before any tree, and the nodes of all trees as records."""

    columns: list[str]
    start: float
    nodes: list[tuple]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE_COLUMNS)


def _edges(rows: DataFrame, names: list[str], bins: int) -> list[list[float]]:
    """Inner bounds per column: between all values where there are at most ``bins``, else at quantiles (rank error 1 / 10,000)."""
    sizes = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    many = [c for c in names if sizes[c] > 2 * bins]
    found = {}
    for c in names:
        if c not in many:
            values = sorted(r[0] for r in rows.filter(~F.isnan(c)).select(c).distinct().limit(bins + 1).collect())
            if len(values) > bins:
                many.append(c)
            else:
                found[c] = [a + (b - a) / 2 for a, b in zip(values, values[1:])] or values or [0.0]
    if many:
        for c, cuts in zip(many, rows.approxQuantile(many, [k / bins for k in range(1, bins)], 1e-4)):
            found[c] = sorted(set(cuts))
    return [[e for e in found[c] if math.isfinite(e)] or [0.0] for c in names]


def _binned(rows: DataFrame, names: list[str], edges: list[list[float]]) -> DataFrame:
    """(label, weight, bins): one small number per input, -1 where it is missing."""
    codes = [f"_b{k}" for k in range(len(names))]
    bounds = [[-math.inf, *inner, math.inf] for inner in edges]
    put = Bucketizer(splitsArray=bounds, inputCols=names, outputCols=codes, handleInvalid="keep").transform(rows)
    bins = [F.when(F.col(c) <= len(inner), F.col(c)).otherwise(F.lit(-1.0)).cast("short") for c, inner in zip(codes, edges)]
    return put.select("label", "weight", F.array(*bins).alias("bins"))


def _routed(nodes: dict[int, Node], at: int, test, leaf) -> str:
    """Nested CASE text that leads a row from node ``at`` to its leaf."""
    node = nodes[at]
    if node.left is None:
        return leaf(at, node)
    return (f"CASE WHEN {test(node.cut)} THEN {_routed(nodes, node.left, test, leaf)} "
            f"ELSE {_routed(nodes, node.right, test, leaf)} END")


def _bin_test(cut: dict) -> str:
    at = f"bins[{cut['feature']}]"
    return f"{at} <= {cut['bin']}" if cut["missing_left"] else f"({at} >= 0 AND {at} <= {cut['bin']})"


def _best_cuts(rows: DataFrame, node: str, inputs: list[int], scale: float, min_rows: int) -> list[dict]:
    """The best cut of every open leaf; leaves without an allowed cut of positive gain have none."""
    listed = rows.withColumn("node", F.expr(node)).filter("node IS NOT NULL").select(
        "node", "g", "h", F.posexplode(F.array(*[F.col("bins")[k] for k in inputs])).alias("input", "bin"))
    sums = listed.groupBy("node", "input", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
    whole = Window.partitionBy("node", "input")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    parts = {}
    for c in ("g", "h", "n"):
        parts |= {f"all_{c}": F.sum(c).over(whole), f"upto_{c}": F.sum(c).over(upto),
                  f"lost_{c}": F.sum(F.when(F.col("bin") < 0, F.col(c)).otherwise(0)).over(whole)}
    told = sums.withColumns(parts).filter("bin >= 0")
    # Missing rows have bin -1, so running sums hold them: once as they are, once without.
    sides = F.explode(F.array(*[
        F.struct(F.lit(stays).alias("missing_left"),
                 *[(F.col(f"upto_{c}") - (0 if stays else F.col(f"lost_{c}"))).alias(f"left_{c}") for c in ("g", "h", "n")])
        for stays in (False, True)]))
    told = told.withColumn("side", sides).select("node", "input", "bin", "all_g", "all_h", "all_n", "side.*")
    right = {c: F.col(f"all_{c}") - F.col(f"left_{c}") for c in ("g", "h", "n")}
    least = math.ceil(MIN_CURVATURE * scale)
    told = told.filter((F.col("left_n") >= min_rows) & (right["n"] >= min_rows) & (F.col("left_h") >= least) & (right["h"] >= least))

    def score(g, h):
        return g.cast("double") * g.cast("double") / h.cast("double")

    gain = score(F.col("left_g"), F.col("left_h")) + score(right["g"], right["h"]) - score(F.col("all_g"), F.col("all_h"))
    told = told.withColumn("gain", gain / scale).filter("gain > 0")
    kept = F.struct("node", "input", "bin", "missing_left", "gain", "left_g", "left_h", "left_n", "all_g", "all_h", "all_n")
    first = F.struct("gain", -F.col("input"), -F.col("bin"), ~F.col("missing_left"))
    # At most one row per open leaf comes back.
    return [r["cut"].asDict() for r in told.groupBy("node").agg(F.max_by(kept, first).alias("cut")).collect()]


def _grow(rows: DataFrame, inputs: list[int], scale: float, totals: tuple[int, int, int], leaves: int, depth: int,
          min_rows: int) -> dict[int, Node]:
    """One tree over rows with ``bins``, ``g`` and ``h``."""
    full = {0: Node(*totals, 0)}
    fresh = {0}
    for level in range(depth):
        place = _routed(full, 0, _bin_test, lambda at, _: str(at) if at in fresh else "CAST(NULL AS INT)")
        made = set()
        for cut in sorted(_best_cuts(rows, place, inputs, scale, min_rows), key=lambda c: c["node"]):
            node = full[cut["node"]]
            left = cut["left_g"], cut["left_h"], cut["left_n"]
            node.cut = {**cut, "feature": inputs[cut["input"]]}
            node.left, node.right = len(full), len(full) + 1
            full[node.left] = Node(*left, level + 1)
            full[node.right] = Node(node.grad - left[0], node.curve - left[1], node.rows - left[2], level + 1)
            made |= {node.left, node.right}
        fresh = made
        if not fresh:
            break
    return _best_first(full, leaves)


def _best_first(full: dict[int, Node], leaves: int) -> dict[int, Node]:
    """The part of a full tree that splits, greatest gain first, until there are ``leaves`` leaves."""
    kept = {0: full[0]}
    heap = [(-full[0].cut["gain"], 0)] if full[0].cut else []
    split = set()
    while heap and len(split) + 1 < leaves:
        at = heapq.heappop(heap)[1]
        split.add(at)
        for child in (full[at].left, full[at].right):
            kept[child] = full[child]
            if full[child].cut:
                heapq.heappush(heap, (-full[child].cut["gain"], child))
    for at, node in kept.items():
        if at not in split:
            node.cut = node.left = node.right = None
    return kept


def train_leafwise(train: DataFrame, columns: list[str], label: str = LABEL, trees: int = TREES, rate: float = LEARNING_RATE,
                   leaves: int = LEAVES, depth: int = DEPTH, min_rows: int = MIN_ROWS_PER_LEAF, share: float = INPUT_SHARE,
                   bins: int = BINS, seed: int = SEED) -> Forest:
    """Fit the trees; positives weigh negatives / positives. Rows whose label is neither 0 nor 1 go."""
    if not columns:
        raise DataError("no numeric model features are available")
    counts = class_counts(train, label).first()
    if not counts["positives"] or not counts["negatives"]:
        raise DataError("training target must contain both classes")
    spark, ratio = train.sparkSession, counts["negatives"] / counts["positives"]
    names = [f"_x{k}" for k in range(len(columns))]
    missing = F.lit(float("nan"))
    rows = train.filter(F.col(label).isin(0, 1)).select(
        F.col(label).cast("int").alias("label"), F.when(F.col(label) == 1, F.lit(ratio)).otherwise(F.lit(1.0)).alias("weight"),
        *[F.coalesce(F.col(f"`{c}`").cast("double"), missing).alias(n) for c, n in zip(columns, names, strict=True)])
    edges = _edges(rows, names, bins)
    current = _stored(_binned(rows, names, edges).withColumn("margin", F.lit(0.0)), spark)
    # The classes weigh the same, so the margin before any tree is 0. No sum can pass 2 ** 62.
    scale = 2.0 ** min(40, math.floor(62 - math.log2(2 * counts["negatives"] + counts["positives"])))
    nodes, since = [], []
    for tree in range(trees):
        margin = " + ".join(["margin", *since])
        chance = f"(1 / (1 + exp(-({margin}))))"
        ready = current.withColumn("p", F.expr(chance)).select(
            "bins", F.round(F.expr("weight * (p - label)") * scale).cast("long").alias("g"),
            F.round(F.expr("weight * p * (1 - p)") * scale).cast("long").alias("h"))
        totals = tuple(ready.agg(F.sum("g"), F.sum("h"), F.count("*")).first())
        inputs = sorted(random.Random(seed * 1_000_003 + tree).sample(range(len(columns)), max(1, round(share * len(columns)))))
        grown = _grow(ready, inputs, scale, totals, leaves, depth, min_rows)
        values = {at: -rate * n.grad / n.curve if n.curve else 0.0 for at, n in grown.items()}
        since.append(_routed(grown, 0, _bin_test, lambda at, _: f"{values[at]!r}D"))
        for at, n in sorted(grown.items()):
            cut = n.cut or {}
            limit = [*edges[cut["feature"]], math.inf][cut["bin"]] if cut else None
            nodes.append((tree, at, cut.get("feature"), cut.get("bin"), limit, cut.get("missing_left"), n.left, n.right,
                          cut.get("gain"), None if cut else values[at], n.rows, n.depth))
        if len(since) == TREES_PER_COPY and tree + 1 < trees:
            current = _stored(current.withColumn("margin", F.expr(" + ".join(["margin", *since]))), spark)
            since = []
    return Forest(list(columns), 0.0, nodes)


def _stored(df: DataFrame, spark: SparkSession) -> DataFrame:
    return spark.read.parquet(write_table(df, scratch_path(spark, "trees")))


def margin_text(forest: Forest, names: list[str]) -> str:
    """SQL text of the sum of all trees; ``names`` are columns that hold null where an input is missing."""
    def test(cut):
        bound = "double('Infinity')" if math.isinf(cut["threshold"]) else f"{cut['threshold']!r}D"
        inside = f"{names[cut['feature']]} < {bound}" if not math.isinf(cut["threshold"]) else f"{names[cut['feature']]} IS NOT NULL"
        return f"coalesce({inside}, {'true' if cut['missing_left'] else 'false'})"

    by_tree: dict[int, dict[int, Node]] = {}
    values: dict[tuple[int, int], float] = {}
    for tree, at, feature, _, threshold, missing_left, left, right, _, value, rows, depth in forest.nodes:
        cut = None if left is None else {"feature": feature, "threshold": threshold, "missing_left": missing_left}
        by_tree.setdefault(tree, {})[at] = Node(0, 0, rows, depth, cut, left, right)
        values[tree, at] = value
    texts = [_routed(nodes, 0, test, lambda at, _, t=tree: f"{values[t, at]!r}D") for tree, nodes in sorted(by_tree.items())]
    return f"aggregate(array({', '.join(texts)}), {forest.start!r}D, (a, b) -> a + b)" if texts else f"{forest.start!r}D"


def score_leafwise(forest: Forest, columns: list[str], rows: DataFrame, name: str = "risk_score") -> DataFrame:
    """Add the probability of the positive class; absent or bad inputs count as missing."""
    names = [f"_x{k}" for k in range(len(columns))]
    kept = rows.withColumn("_row", F.struct(*rows.columns)).select("_row", *aligned(rows, columns))
    clean = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(n) for c, n in zip(columns, names, strict=True)]
    margin = kept.select("_row", *clean).withColumn("_margin", F.expr(margin_text(forest, names)))
    return margin.select("_row.*", (1 / (1 + F.exp(-F.col("_margin")))).alias(name))


def leafwise_importance(forest: Forest, spark: SparkSession) -> DataFrame:
    """(feature, importance): every input's share of all splits."""
    used = [n[2] for n in forest.nodes if n[2] is not None]
    return spark.createDataFrame([(c, used.count(k) / max(1, len(used))) for k, c in enumerate(forest.columns)],
                                 "feature string, importance double")


def save_leafwise(spark: SparkSession, path: str, forest: Forest) -> None:
    forest.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(forest.columns, forest.start)], "columns array<string>, start double").write.mode("overwrite").parquet(f"{path}/inputs")


def load_leafwise(spark: SparkSession, path: str) -> Forest:
    try:
        inputs = spark.read.parquet(f"{path}/inputs").first()
        nodes = sorted(tuple(r) for r in spark.read.parquet(f"{path}/nodes").collect())
    except Exception as error:
        raise MissingTableError("the trained trees cannot be loaded") from error
    if inputs is None or not inputs["columns"]:
        raise DataError("the model feature contract is invalid")
    return Forest(list(inputs["columns"]), inputs["start"], nodes)
