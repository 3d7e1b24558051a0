"""Cases that the given tables do not contain: absent features, NULL keys, NaN, repeated sample ids, large counts."""

import math

import pytest
from pyspark.sql import functions as F

from probestats.operators import describe, errors, evaluate, fdr, folds, ordered, performance, rank, score, stage, twosample
from probestats.plans import study


def test_values_stand_at_their_features_place(spark):
    rows = [("a", 0, 1.0), ("a", 2, 3.0), ("a", 3, 4.0), ("b", 1, 2.0), ("b", 5, 9.0)]
    betas = spark.createDataFrame(rows, "sample_id string, feature_pos int, beta double").withColumns({"cohort": F.lit("c"), "dataset": F.lit("d")})
    blocks = {(r["sample_id"], r["segment_id"]): r["values"] for r in errors.to_blocks(betas, width=4).collect()}
    assert blocks == {("a", 0): [1.0, None, 3.0, 4.0], ("b", 0): [None, 2.0, None, None], ("b", 1): [None, 9.0]}
    back = errors.to_long(errors.to_blocks(betas, width=4), width=4).where("beta IS NOT NULL")
    assert sorted((r["sample_id"], r["feature_pos"], r["beta"]) for r in back.collect()) == sorted(rows)


def test_summary_has_every_segment(spark):
    rows = [("cases", "d", "s", f, float(f)) for f in range(9)]
    errs = spark.createDataFrame(rows, "cohort string, dataset string, sample_id string, feature_pos int, sq_err double")
    assert [c for c in errors.error_summary(errs, width=2).columns if c.startswith("mse_segment")] == [f"mse_segment_{i}" for i in range(1, 6)]
    with pytest.raises(ValueError):
        errors.error_summary(errs, 4, width=2)


@pytest.mark.parametrize("hot_rows", [None, 0])
def test_null_keys_are_a_group(spark, hot_rows):
    tests = spark.createDataFrame([("a", 0.5), (None, 0.01), (None, 0.04), ("a", None)], "g string, p double")
    got = sorted((r["g"] or "", r["q"]) for r in fdr.bh_fdr(tests, "p", by=["g"], name="q", hot_rows=hot_rows).collect())
    assert got == [("", 0.02), ("", 0.04), ("a", 1.0), ("a", 1.0)]
    values = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    assert {(r["g"], r["m"], r["n"]) for r in ordered.exact_quantiles(values, ["g"], "v", {"m": 0.5}, hot_rows=hot_rows).collect()} == {(None, 2.0, 2), ("a", 5.0, 1)}
    assert {(r["g"], r["v"], r["row_rank"]) for r in ordered.row_ranks(values, ["g"], "v", hot_rows=hot_rows).collect()} == {(None, 1.0, 1), (None, 3.0, 2), ("a", 5.0, 1)}


def test_null_dataset_is_scored_and_described(spark):
    rows = [("cases", None, "s", f, float(f + 1)) for f in range(3)]
    errs = spark.createDataFrame(rows, "cohort string, dataset string, sample_id string, feature_pos int, sq_err double")
    assert sorted(r["sq_err"] for r in score.median_normalize(errs, value="sq_err").collect()) == [0.5, 1.0, 1.5]
    assert errors.error_metrics(errs).first()["median_ae"] == pytest.approx(math.sqrt(2))
    assert describe.box_stats(errs, "sq_err", ["dataset"]).first()["median"] == 2.0


def test_features_that_are_not_numbers_rank_last(spark):
    rows = [(f, s, s % 2 + 1, s // 2 % 2, float(s * (f + 1) + s % 3) if (f, s) != (0, 3) else float("nan")) for f in range(3) for s in range(12)]
    df = spark.createDataFrame(rows, "feature_pos int, sample_id int, fold int, label int, score double")
    ranked = {(r["fold"], r["feature_pos"]): r["rank"] for r in rank.rank_features(rank.fold_moments(df, n_splits=2), top=3).collect()}
    assert ranked[1, 0] == 3  # sample 3 is in fold 2, so fold 1 trains on it
    means = spark.createDataFrame([(1, 2.0, 1.0), (2, float("nan"), 1.0), (3, 2.0, float("nan")), (4, 2.0, None), (5, None, 1.0)], "i int, mean1 double, mean0 double")
    assert [r["i"] for r in means.where(rank.passes_ratio()).collect()] == [1]


def test_samples_of_two_files_share_ids(spark):
    rows = [(c, d, s, f, float((s * 7 + f * 3 + (c == "cases") * f) % 11)) for c in ("cases", "controls") for d in ("x", "y") for s in range(6) for f in range(4)]
    df = spark.createDataFrame(rows, "cohort string, dataset string, sample_id int, feature_pos int, score double")
    models = {"Forest": lambda: evaluate.RandomForestClassifier(numTrees=3, seed=1)}
    aucs, _ = study.classification(df, n_splits=3, grid=(2,), models=models)
    assert aucs.count() == 3
    samples = df.select("cohort", "dataset", "sample_id").distinct().withColumn("label", (F.col("cohort") == "cases").cast("int"))
    dealt = folds.assign_folds(samples, key=["cohort", "dataset", "sample_id"], n_splits=3)
    assert dealt.count() == 24 and {r["count"] for r in dealt.groupBy("fold", "label").count().collect()} == {4}


def test_distance_of_huge_groups(spark):
    """Counts whose products outgrow 64 bits, by summed-up weights."""
    steps = spark.createDataFrame([(4_000_000_000, 1), (1, 4_000_000_000)], "case long, ctrl long")
    wide = {c: F.sum(c).cast("decimal(19,0)") for c in steps.columns}
    assert int(steps.agg((wide["case"] * wide["ctrl"]).alias("x")).first()["x"]) == 4_000_000_001**2
    stats = twosample.ks_statistic(spark.createDataFrame([(1, "cases", 1.0), (1, "controls", 2.0)], "feature_pos int, cohort string, score double"))
    assert stats.schema["gap"].dataType.simpleString() == "decimal(38,0)"


def test_unlisted_models_raise(spark):
    rows = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.7)], "k int, model string, auc double")
    assert evaluate.mean_auc(rows).columns == ["k", "A", "B"]
    with pytest.raises(ValueError):
        evaluate.mean_auc(rows, ["A"])
    with pytest.raises(ValueError):
        performance.heatmap(rows.withColumnRenamed("auc", "auc_plot"), ["B"])


def test_equal_rows_of_a_hot_key_stay_where_they_are(spark):
    rows = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), F.lit(1.0).alias("v"))
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    out = ordered.join_lookup(rows, lookup, ["k"], size="n", hot_rows=100)
    assert out.count() == 3000 and out.where("k = -1").select(F.max("s")).first()[0] == 2000.0
    sizes = [r["n"] for r in out.where("k = -1").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 6 and max(sizes) < 400


@pytest.mark.parametrize("values", ["narrow", "third"])
def test_narrow_and_equal_values_are_spread(spark, values):
    """A million distinct doubles in [1, 1.00002), and as many of which a third are equal: no task gets a large share."""
    n = 1_000_000
    v = 1 + F.col("id") * 2e-11 if values == "narrow" else F.when(F.col("id") % 3 == 0, F.lit(1.5)).otherwise(1 + F.col("id") * 2e-11)
    rows = spark.range(0, n, 1, 8).select(v.alias("v"))
    levels = rows.distinct()
    celled = ordered.find_cells(levels, [], "v", hot_rows=20_000).add(levels, "v")
    assert celled.groupBy(ordered.CELL).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 20_000
    totals, _ = ordered.running_totals(rows, [], "v", {"n": F.lit(1)}, hot_rows=20_000)
    last = totals.orderBy(F.desc("v")).first()
    assert (last["n_cum"], last["n_total"]) == (n, n)
    got = ordered.exact_quantiles(rows, [], "v", {"m": 0.5}, hot_rows=20_000).first()
    assert got["m"] == pytest.approx(1 + 499_999.5 * 2e-11 if values == "narrow" else rows.agg(F.percentile("v", 0.5)).first()[0], abs=1e-15)


def test_quoted_separators(spark, tmp_path):
    from probestats.sources import tables

    (tmp_path / "q.csv").write_text('CpG,a,b\n"cg,2",0.3,0.4\n"cg""3" , "0.5",1\n')
    wide, _ = tables.read_matrix(spark, str(tmp_path / "q.csv"), cohort="cases", dataset="q")
    assert {r["cpg_id"]: r["values"] for r in wide.collect()} == {"cg,2": [0.3, 0.4], 'cg"3': [0.5, 1.0]}
    (tmp_path / "long.csv").write_text("CpG,a,b\ncg1,1,2,3\n")
    with pytest.raises(Exception, match="more than 3 fields"):
        tables.read_matrix(spark, str(tmp_path / "long.csv"), cohort="cases", dataset="q")[0].collect()


def test_no_shared_folder_raises(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        stage.shared_folder(Session)


def test_the_full_sweep_is_the_default():
    assert list(evaluate.DEFAULT_GRID) == list(range(1, 501))
    suite = evaluate.classifiers()
    assert len(suite) == 4 and suite["RandomForest"]().getMaxDepth() == 30 and suite["RandomForest"]().getNumTrees() == 100


@pytest.mark.parametrize("method", ["auto", "exact", "finite"])
def test_ks_statistics_are_worked_out_once(spark, method):
    """The statistics stand for a sort of all values, which p-values must not repeat for each of their readings."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(i, 5, 7, i if i else None, i / 35 if i else None) for i in range(20)]
    plain = spark.createDataFrame(rows, "feature_pos long, n_case long, n_ctrl long, gap long, d double")
    stats = plain.mapInArrow(counted, plain.schema)
    found = {r["feature_pos"]: r["p_ks"] for r in twosample.ks_pvalue(stats, method=method).collect()}
    assert made.value == len(rows) == len(found) and found[0] is None and all(0 <= p <= 1 for i, p in found.items() if i)
