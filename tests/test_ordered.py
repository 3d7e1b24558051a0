"""Hot groups must give what small groups give: every key is forced through the cells (hot_rows=0)."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from probestats.operators import evaluate, fdr, ordered, twosample
from probestats.functions.draws import draw_cell, draw_key


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows, two thirds of them in key 0, a third of the values equal, some NULL, both signs."""
    rng = np.random.default_rng(5)
    n = 20_000
    pdf = pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.66, 0, rng.integers(1, 40, n)),
            "v": np.where(rng.random(n) < 0.33, 1.0, rng.normal(0, 10, n) ** 3),
            "label": rng.integers(0, 2, n),
            "id": np.arange(n),
        }
    )
    pdf.loc[rng.random(n) < 0.05, "v"] = 0.0
    pdf["cohort"] = np.where(pdf.label == 1, "cases", "controls")
    spark_rows = spark.createDataFrame(pdf).repartition(7)
    spark_rows = spark_rows.withColumn("v", F.when(F.col("id") % 17 != 0, F.col("v"))).cache()
    pdf.loc[pdf.id % 17 == 0, "v"] = np.nan
    return spark_rows, pdf


@pytest.mark.parametrize("hot_rows", [0, 5_000, None])
def test_quantiles(skewed, hot_rows):
    rows, pdf = skewed
    probs = {"lo": 0.05, "mid": 0.5, "hi": 0.95, "end": 1.0}
    got = ordered.exact_quantiles(rows, ["k"], "v", probs, hot_rows=hot_rows).toPandas().set_index("k").sort_index()
    want = pdf.groupby("k")["v"].quantile(list(probs.values())).unstack()
    np.testing.assert_allclose(got[list(probs)].to_numpy(), want.to_numpy(), rtol=1e-12)
    assert (got["n"] == pdf.groupby("k")["v"].count()).all()


def test_global_quantiles(skewed):
    rows, pdf = skewed
    got = ordered.exact_quantiles(rows, [], "v", {"q": 0.95}).first()
    assert got["q"] == pytest.approx(pdf.v.quantile(0.95), rel=1e-12)


@pytest.mark.parametrize("hot_rows", [0, 5_000, None])
def test_running_totals(skewed, hot_rows):
    rows, pdf = skewed
    data = rows.where("v is not null")
    got = ordered.running_totals(data, ["k"], "v", {"n": F.lit(1), "pos": F.col("label")}, hot_rows=hot_rows)[0].toPandas()
    known = pdf.dropna(subset="v").groupby(["k", "v"]).agg(n=("label", "size"), pos=("label", "sum")).reset_index()
    known["n_cum"], known["pos_cum"] = known.groupby("k").n.cumsum(), known.groupby("k").pos.cumsum()
    known["n_total"] = known.groupby("k").n.transform("sum")
    columns = ["k", "v", "n", "n_cum", "pos_cum", "n_total"]
    got = got[columns].sort_values(["k", "v"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, known[columns], check_dtype=False)


def test_cells_never_fall_as_values_grow(spark):
    inf, nan = float("inf"), float("nan")
    values = [None, -inf, -1e308, -1.0, -1e-300, -0.0, 0.0, 5e-324, 1e-300, 1.0, 1.0000001, 2.9999999, 3.0, 1e308, inf, nan]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int")
    cells = ordered.find_cells(rows, [], "v", hot_rows=0)
    found = cells.add(rows, "v").withColumn("top", cells.top()).orderBy("i").collect()
    assert [r[ordered.CELL] for r in found] == sorted(r[ordered.CELL] for r in found)
    assert [r["top"] for r in found] == sorted(r["top"] for r in found)
    assert len({r[ordered.CELL] for r in found}) > 10


@pytest.mark.parametrize("keyed", [False, True])
def test_an_outlier_does_not_widen_the_cells(spark, keyed):
    """999,999 doubles in [1, 1 + 8e-9] and one far away."""
    n = 1_000_000
    v = F.when(F.col("id") == 0, F.lit(1.00004)).otherwise(1 + F.col("id") * 8e-15)
    rows = spark.range(0, n, 1, 8).select(v.alias("v"), F.lit(7).alias("k"))
    keys = ["k"] if keyed else []
    cells = ordered.find_cells(rows, keys, "v", hot_rows=10_000)
    sizes = cells.add(rows, "v").groupBy(ordered.CELL).agg(F.count("*").alias("n"), F.countDistinct("v").alias("d")).collect()
    assert max(r["n"] for r in sizes if r["d"] > 1) <= 10_000 and 100 <= len(sizes) <= 3 * ordered.RANGES
    totals, _ = ordered.running_totals(rows, keys, "v", {"n": F.lit(1)}, hot_rows=10_000)
    assert totals.where("n_total <> 1000000").isEmpty() and totals.agg(F.max("n_cum"), F.count("*")).first()[0] == n


def test_quantiles_read_the_rows_twice(spark, tmp_path):
    """Groups far larger than the sketch: one scan sketches, one looks into the brackets, which hold few of the values."""
    rows = spark.range(0, 300_000, 1, 4).select((F.col("id") % 3).alias("k"), F.xxhash64("id").cast("double").alias("v"))
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    for keys in ([], ["k"]):
        got = ordered.exact_quantiles(spark.read.parquet(path), keys, "v", {"a": 0.25, "b": 0.5}, sketch=4096)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # the scan for the sketches is done; one more is left, besides that of the few brackets (_n, _b)
        assert len(re.findall(r"FileScan parquet \[[^\]]*\bv#", plan)) == 1
        want = rows.groupBy(*keys).agg(F.percentile("v", [0.25, 0.5]).alias("q"), F.count("*").alias("n"))
        found, wanted = ([list(map(float, x)) for x in sorted(rows)] for rows in (((r["n"], r["a"], r["b"]) for r in got.collect()), ((r["n"], *r["q"]) for r in want.collect())))
        np.testing.assert_allclose(found, wanted, rtol=1e-12)


@pytest.mark.parametrize("sketch", [8, 200, 4096])
@pytest.mark.parametrize("small_groups", [False, True])
def test_quantiles_for_any_sketch(skewed, sketch, small_groups):
    rows, pdf = skewed
    probs = {"lo": 0.0, "some": 0.31, "mid": 0.5, "end": 1.0}
    got = ordered.exact_quantiles(rows, ["k"], "v", probs, sketch=sketch, small_groups=small_groups, hot_rows=500).toPandas().set_index("k").sort_index()
    np.testing.assert_allclose(got[list(probs)].to_numpy(), pdf.groupby("k")["v"].quantile(list(probs.values())).unstack().to_numpy(), rtol=1e-12)


def test_hot_keys_that_a_lookup_lacks_are_not_moved(spark):
    rows = spark.range(0, 9_000, 1, 6).select(F.when(F.col("id") % 3 == 0, F.col("id") % 100).otherwise(-1).alias("k"), "id")
    lookup = spark.range(0, 50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("double"))
    out = ordered.join_lookup(rows, lookup, ["k"], hot_rows=1_000)
    assert out.count() == 1_500 and out.where("double <> 2 * k").isEmpty()
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti, BuildRight" in text and "Union" in text  # rows of key -1 meet a broadcast on both ways


@pytest.mark.parametrize("limit", [None, 777])
def test_row_ranks(skewed, limit):
    rows, pdf = skewed
    shuffled = rows.withColumn("d", draw_key(1, F.col("id")))
    got = ordered.row_ranks(shuffled, [], "d", ["id"], cells=[draw_cell(F.col("d"))], limit=limit).toPandas()
    assert sorted(got.row_rank) == list(range(1, (limit or len(pdf)) + 1))
    assert list(got.sort_values("row_rank").d) == sorted(got.d)


def test_row_ranks_by_value_within_keys(skewed):
    rows, pdf = skewed
    got = ordered.row_ranks(rows.where("v is not null"), ["k"], "v", ["id"], hot_rows=0).toPandas()
    want = pdf.dropna(subset="v").sort_values(["k", "v", "id"])
    want["row_rank"] = want.groupby("k").cumcount() + 1
    merged = got[["id", "row_rank"]].merge(want[["id", "row_rank"]], on="id")
    assert len(merged) == len(want) and (merged.row_rank_x == merged.row_rank_y).all()


@pytest.mark.parametrize("hot_rows", [0, 5_000, None])
@pytest.mark.parametrize("size", ["n", None])
def test_join_lookup(spark, skewed, hot_rows, size):
    rows, pdf = skewed
    sizes = pdf.groupby("k").size().rename("n").reset_index()
    sizes["mark"] = [None if k == 3 else f"m{k}" for k in sizes.k]
    lookup = spark.createDataFrame([tuple(r) for r in sizes[sizes.k != 7].itertuples(index=False)], "k long, n long, mark string")
    if size is None:
        lookup = lookup.drop("n")
    got = ordered.join_lookup(rows.select("k", "id"), lookup, ["k"], size=size, hot_rows=hot_rows).toPandas()
    want = pdf[pdf.k != 7]
    assert sorted(got.id) == sorted(want.id)
    assert all(m == f"m{k}" or (k == 3 and m is None) for k, m in zip(got.k, got["mark"]))


@pytest.mark.parametrize("hot_rows", [0, None])
def test_ks_statistic_and_auc_against_numpy(skewed, hot_rows):
    rows, pdf = skewed
    got = twosample.ks_statistic(rows, ["k"], "v", hot_rows=hot_rows).toPandas().set_index("k")
    auc = evaluate.roc_auc(rows, ["k"], score="v", hot_rows=hot_rows).toPandas().set_index("k")
    for k, part in pdf.dropna(subset="v").groupby("k"):
        x, y = part.v[part.label == 1].to_numpy(), part.v[part.label == 0].to_numpy()
        grid = np.unique(part.v)
        cx = np.searchsorted(np.sort(x), grid, "right")
        cy = np.searchsorted(np.sort(y), grid, "right")
        assert int(got.loc[k, "gap"]) == np.abs(cx * len(y) - cy * len(x)).max()
        wins = (x[:, None] > y[None, :]).mean() + 0.5 * (x[:, None] == y[None, :]).mean()
        assert auc.loc[k, "auc"] == pytest.approx(wins, abs=1e-12)


@pytest.mark.parametrize("hot_rows", [0, None])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_bh_against_definition(skewed, hot_rows, by):
    rows, pdf = skewed
    tests = rows.withColumn("p", F.abs("v") / 60_000)
    got = fdr.bh_fdr(tests, "p", by=by, name="q", hot_rows=hot_rows).select("id", "k", "p", "q").toPandas()
    assert len(got) == len(pdf)
    groups = [got] if not by else [g for _, g in got.groupby("k")]
    for g in groups:
        p = g.p.fillna(1.0).to_numpy()
        order = np.argsort(p, kind="stable")
        raw = p[order] * len(p) / np.arange(1, len(p) + 1)
        q = np.empty(len(p))
        q[order] = np.clip(np.minimum.accumulate(raw[::-1])[::-1], 0, 1)
        np.testing.assert_allclose(g.q.to_numpy(), q, rtol=1e-12)
