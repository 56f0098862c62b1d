"""Leaf-wise trees against a plain best-first version, their limits, missing inputs, and a written model."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.constants import LABEL
from cellweft.errors import DataError, MissingTableError
from cellweft.operators import learn, leafwise
from cellweft.operators.evaluate import average_precision

INPUTS = ["a", "b", "c", "gone"]


def made_rows(n=900, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 12, n), rng.integers(0, 9, n), rng.normal(size=n)
    odds = (a > 7) * 2.0 + (b == 3) * 1.5 - 2.2 + (np.abs(c) < 0.4) * 1.2
    y = (rng.random(n) < 1 / (1 + np.exp(-odds))).astype(int)
    lost = rng.random(n) < 0.15 + 0.3 * y
    return [(k, float(a[k]) if not lost[k] else None, int(b[k]), float(c[k]) if k % 11 else float("nan"), None, int(y[k])) for k in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made_rows(), f"id long, a double, b int, c double, gone double, {LABEL} int")


def plain_tree(x, g, h, leaves, depth, min_rows):
    """Best-first growth, one leaf at a time: the set of (depth, rows, value numerator, value denominator) of its leaves."""
    def best(members):
        found = None
        for k in range(x.shape[1]):
            column = x[members, k]
            values = np.unique(column[~np.isnan(column)])
            for v in values:
                for keeps in (False, True):
                    left = members[np.where(np.isnan(column), keeps, column <= v)]
                    right = np.setdiff1d(members, left)
                    if min(len(left), len(right)) < min_rows or min(h[left].sum(), h[right].sum()) < 1e-3:
                        continue
                    gain = sum(s * g[m].sum() ** 2 / h[m].sum() for s, m in ((1, left), (1, right), (-1, members)))
                    if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                        found = gain, left, right
        return found

    open_leaves = [(0, np.arange(len(g)))]
    while len(open_leaves) < leaves:
        cuts = [(best(m), at) for at, (d, m) in enumerate(open_leaves) if d < depth]
        cuts = [(c, at) for c, at in cuts if c]
        if not cuts:
            break
        (_, left, right), at = max(cuts, key=lambda c: c[0][0])
        d = open_leaves.pop(at)[0]
        open_leaves += [(d + 1, left), (d + 1, right)]
    return open_leaves


def test_one_tree_equals_the_plain_version(spark, rows):
    data = made_rows()
    x = np.array([[np.nan if v is None else v for v in r[1:3]] for r in data], float)
    y = np.array([r[5] for r in data])
    weight = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    g, h = weight * (0.5 - y), weight * 0.25
    for leaves, depth in ((15, 5), (6, 5), (15, 2)):
        want = sorted((d, len(m), round(-0.05 * g[m].sum() / h[m].sum(), 6)) for d, m in plain_tree(x, g, h, leaves, depth, 5))
        forest = leafwise.train_leafwise(rows, ["a", "b"], trees=1, leaves=leaves, depth=depth, share=1.0)
        got = sorted((n[11], n[10], round(n[9], 6)) for n in forest.nodes if n[6] is None)
        assert got == want


def test_limits_scores_and_written_model(spark, rows, tmp_path):
    train, held = rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0")
    forest = leafwise.train_leafwise(train, INPUTS, trees=12)
    leaves = Counter(n[0] for n in forest.nodes if n[6] is None)
    assert len(leaves) == 12 and 2 <= min(leaves.values()) and max(leaves.values()) <= 15
    assert max(n[11] for n in forest.nodes) <= 5 and min(n[10] for n in forest.nodes) >= 5
    assert all(n[2] != 3 for n in forest.nodes)  # a column without values is never cut
    scored = leafwise.score_leafwise(forest, INPUTS, held)
    assert scored.columns == [*held.columns, "risk_score"]
    ours = average_precision(scored, "risk_score", LABEL).first()[0]
    levels = learn.train_classifier(train, INPUTS, LABEL, trees=12)
    theirs = average_precision(learn.score_rows(levels, INPUTS, held), "risk_score", LABEL).first()[0]
    assert ours > 0.5 and ours >= theirs - 0.02
    leafwise.save_leafwise(spark, str(tmp_path), forest)
    again = leafwise.load_leafwise(spark, str(tmp_path))
    assert again == forest
    share = {r["feature"]: r["importance"] for r in leafwise.leafwise_importance(forest, spark).collect()}
    assert math.isclose(sum(share.values()), 1.0) and share["gone"] == 0.0
    with pytest.raises(MissingTableError):
        leafwise.load_leafwise(spark, str(tmp_path / "none"))


def test_trees_do_not_depend_on_partitions(spark, rows):
    first = leafwise.train_leafwise(rows.repartition(1), ["a", "b"], trees=3)
    assert leafwise.train_leafwise(rows.repartition(13, "id"), ["a", "b"], trees=3) == first


def test_scores_follow_the_routes(spark, rows):
    """Margins of the column expression are those of a walk over the node table; absent and bad inputs count as missing."""
    forest = leafwise.train_leafwise(rows, INPUTS, trees=5)
    nodes = {(n[0], n[1]): n for n in forest.nodes}

    def walk(row):
        total = 0.0
        for tree in range(5):
            at = 0
            while nodes[tree, at][6] is not None:
                _, _, feature, _, bound, missing_left, left, right, *_ = nodes[tree, at]
                v = row[INPUTS[feature]]
                goes = missing_left if v is None or v != v else v < bound
                at = left if goes else right
            total += nodes[tree, at][9]
        return 1 / (1 + math.exp(-total))

    for row in leafwise.score_leafwise(forest, INPUTS, rows).collect():
        assert math.isclose(row["risk_score"], walk(row), rel_tol=1e-9)
    bare = leafwise.score_leafwise(forest, INPUTS, rows.select("id", F.lit("x").alias("a")).limit(1)).first()
    assert math.isclose(bare["risk_score"], walk(dict.fromkeys(INPUTS)), rel_tol=1e-9)


def test_many_values_and_odd_tables(spark):
    rng = np.random.default_rng(8)
    data = [(float(v), int(v > 0.3)) for v in rng.normal(size=4_000)]
    many = spark.createDataFrame(data, f"v double, {LABEL} int")
    forest = leafwise.train_leafwise(many, ["v"], trees=2, bins=64)
    assert any(abs(n[4] - 0.3) < 0.1 for n in forest.nodes if n[4] is not None)
    with pytest.raises(DataError):
        leafwise.train_leafwise(many.filter(f"{LABEL} = 1"), ["v"])
    with pytest.raises(DataError):
        leafwise.train_leafwise(many, [])
    flat = leafwise.train_leafwise(many.withColumn("v", F.lit(1.0)), ["v"], trees=2)
    assert [n[6] for n in flat.nodes] == [None, None]
