"""Extremely randomised trees against a plain recursive version with the same draws."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probestats.functions.draws import permuted
from probestats.operators.trees import ExtraTrees


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def place(x, n, *key):
    a = math.ceil(math.sqrt(n))
    b = math.ceil(n / a)
    while True:
        row, column = divmod(x, b)
        for turn in (0, 2):
            row = (row + draw(*key, turn, column)) % a
            column = (column + draw(*key, turn + 1, row)) % b
        x = row * b + column
        if x < n:
            return x


def test_keyed_permutations(spark):
    for n in (1, 2, 3, 7, 50, 1000):
        rows = spark.range(0, n).withColumn("y", permuted(F.col("id"), F.lit(n).cast("bigint"), 5, F.lit("a")))
        got = {r["id"]: r["y"] for r in rows.collect()}
        assert got == {x: place(x, n, 5, "a") for x in range(n)} and sorted(got.values()) == list(range(n))


def test_prefixes_of_permutations_are_spread(spark):
    """The first ten of a thousand numbers, for 4,000 keys: every number as often as any other, no two together too often."""
    rows = spark.range(0, 4000).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(9))))
    drawn = rows.select("id", permuted(F.col("s").cast("bigint"), F.lit(1000).cast("bigint"), 7, F.col("id")).alias("x")).toPandas()
    assert (drawn.groupby("id").x.nunique() == 10).all()
    often = np.bincount(drawn.x, minlength=1000)
    assert ((often - 40) ** 2 / 40).sum() < 1000 + 5 * math.sqrt(2 * 1000)  # chi square
    marked = drawn[drawn.x % 20 == 0].groupby("id").x.count().reindex(range(4000), fill_value=0)
    assert marked.mean() == pytest.approx(0.5, abs=0.05) and marked.var() == pytest.approx(10 * 0.05 * 0.95 * 990 / 999, rel=0.1)


def grown(x, y, held, k, fold, tree, model):
    """Score of each held-out row, by recursion."""
    m, out = max(int(k**0.5), 1), {}

    def go(node, train, told, at):
        key = (fold, k, tree, node)
        cases = int(y[train].sum())
        best, drawn = None, []
        if 0 < cases < len(train) and node < 1 << model.depth:
            drawn = [place(s, k, model.seed, *key) for s in range(at, min(at + m, k))]
            for s, f in enumerate(drawn):
                low, high = x[train, f].min(), x[train, f].max()
                if low < high:
                    t = low + draw(model.seed, "threshold", *key, f) / 2**32 * (high - low)
                    left = x[train, f] <= t
                    if 0 < left.sum() < len(train):
                        sides = [(int(y[train][side].sum()), int(side.sum())) for side in (left, ~left)]
                        way = (sum(p * (n - p) / n for p, n in sides), s, f, t)
                        best = min(best or way, way)
            if best is None and at + m < k:
                return go(node, train, told, at + m)
        if best is None:
            out.update({int(i): cases / len(train) for i in told})
            return None
        _, _, f, t = best
        for side, child in ((x[:, f] <= t, 2 * node), (x[:, f] > t, 2 * node + 1)):
            go(child, train[side[train]], told[side[told]], 0)

    go(1, np.flatnonzero(~held), np.flatnonzero(held), 0)
    return out


@pytest.mark.parametrize("depth", [30, 2])
def test_trees_equal_the_recursive_ones(spark, depth):
    rng = np.random.default_rng(3)
    n, model, grid = 60, ExtraTrees(trees=3, depth=depth, seed=11), (1, 5)
    x = np.round(rng.normal(size=(n, 5)), 2)
    x[:, 2] = 1.0  # a constant feature
    x[:, 0] = rng.integers(0, 3, n)
    y = (x[:, 1] + rng.normal(size=n) * 0.5 > 0).astype(int)
    data = []
    for fold in (1, 2):
        held = np.arange(n) % 3 == fold
        data += [(fold, int(y[i]), bool(held[i]), x[i].tolist()) for i in range(n)]
    vectors = spark.createDataFrame(data, "model_fold int, label int, held_out boolean, values array<double>").repartition(3)
    found = model.held_out_scores(vectors, (1, 2), grid).collect()
    for fold in (1, 2):
        held = np.arange(n) % 3 == fold
        for k in grid:
            trees = [grown(x, y, held, k, fold, tree, model) for tree in range(model.trees)]
            want = sorted((int(y[i]), round(sum(t[i] for t in trees) / model.trees, 9)) for i in np.flatnonzero(held))
            assert sorted((r["label"], round(r["score"], 9)) for r in found if (r["fold"], r["k"]) == (fold, k)) == want


def _noise(spark, n=240, k=4):
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=(n, k)), 2), rng.integers(0, 2, n)
    data = [(1, int(y[i]), i % 4 == 0, x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(data, "model_fold int, label int, held_out boolean, values array<double>").repartition(4)


def test_small_nodes_are_finished_by_one_task(spark, monkeypatch):
    """Trees of noise are deep; written tables, and so jobs, must not follow their depth."""
    from probestats.operators import trees

    names, plain = [], trees.stage
    monkeypatch.setattr(trees, "stage", lambda df, name: (names.append(name), plain(df, name))[1])
    assert ExtraTrees(trees=2, seed=4).held_out_scores(_noise(spark), (1,), (4,)).count() == 60
    assert len(names) <= 4


def test_trees_do_not_depend_on_who_grows_a_node(spark):
    vectors = _noise(spark)
    found = []
    for few_rows in (0, 30, 10_000):  # level by level, mixed, at once
        rows = ExtraTrees(trees=2, depth=7, seed=4, few_rows=few_rows).held_out_scores(vectors, (1,), (4,)).collect()
        found.append(sorted((r["label"], round(r["score"], 9)) for r in rows))
    assert len(found[0]) == 60 and found[0] == found[1] == found[2]
