"""Segment networks, classifier sweeps, and the chained study."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probestats.operators import errors, evaluate, performance, stage as module
from probestats.plans import study

WEIGHTS = (
    "segment_id int, layer int, activation string, weight array<double>, bias array<double>, bn_gamma array<double>,"
    " bn_beta array<double>, bn_mean array<double>, bn_var array<double>, bn_eps double"
)


def network(rng, sizes):
    layers = []
    for n, (a, b) in enumerate(zip(sizes, sizes[1:]), 1):
        last = n == len(sizes) - 1
        bn = [None] * 4 if last else [rng.random(b) + 0.5, rng.random(b), rng.random(b), rng.random(b) + 0.1]
        layers.append((n, "sigmoid" if last else "relu", rng.normal(size=(b, a)), rng.normal(size=b), bn))
    return layers


def run(layers, x):
    for _, activation, w, b, (gamma, beta, mean, var) in layers:
        x = w @ x + b
        x = np.maximum(x, 0) if activation == "relu" else 1 / (1 + np.exp(-x))
        if gamma is not None:
            x = (x - mean) / np.sqrt(var + 1e-5) * gamma + beta
    return x


@pytest.mark.parametrize("half", [False, True])
def test_reconstruction(spark, half):
    rng = np.random.default_rng(2)
    nets = {s: network(rng, [4, 3, 2, 3, 4]) for s in (0, 1)}
    rows = [
        (s, n, act, w.ravel().tolist(), b.tolist(), *[None if v is None else v.tolist() for v in bn], 1e-5)
        for s, layers in nets.items()
        for n, act, w, b, bn in layers
    ]
    weights = spark.createDataFrame(rows, WEIGHTS)
    x = rng.random((9, 12))  # the third segment has no model
    x[0, 1] = 0.0
    betas = spark.createDataFrame(
        [("cases", "d", f"s{i}", j, None if (i, j) == (2, 5) else float(v)) for i, row in enumerate(x) for j, v in enumerate(row)],
        "cohort string, dataset string, sample_id string, feature_pos int, beta double",
    )
    blocks = errors.to_blocks(betas, width=4)
    found = errors.reconstruct(blocks, weights, samples_per_task=2, half_precision=half)
    out = {(int(r.sample_id[1:]), r.feature_pos): r.sq_err for r in errors.to_long(found, values="sq_errs", value="sq_err", width=4).collect()}
    assert len(out) == 9 * 12
    for i in range(9):
        for s in (0, 1):
            part = x[i, 4 * s : 4 * s + 4].copy()
            if half:
                part = part.astype(np.float16).astype(float)
            if i == 2 and s == 1:
                part[1] = 0.0
            want = (run(nets[s], part) - part) ** 2
            for j in range(4):
                got = out[i, 4 * s + j]
                if (i, 4 * s + j) in ((0, 1), (2, 5)):
                    assert got is None
                else:
                    assert got == pytest.approx(want[j], rel=2e-2 if half else 1e-9, abs=2e-3 if half else 1e-12)
        assert all(out[i, j] is None for j in range(8, 12))
    checks = errors.check_matrix(betas, weights, n_features=12, width=4).collect()
    assert [(r.problem, r.subject) for r in checks] == [("segment_without_model", "2")]


def test_squared_error_join(spark):
    schema = "cohort string, dataset string, sample_id string, feature_pos int, {} double"
    betas = spark.createDataFrame([("c", "d", "s", 0, 0.5), ("c", "d", "s", 1, 0.0), ("c", "d", "s", 2, 0.4)], schema.format("beta"))
    predictions = spark.createDataFrame([("c", "d", "s", 0, 0.7), ("c", "d", "s", 1, 0.7)], schema.format("prediction"))
    got = [r.sq_err for r in errors.squared_error(betas, predictions).orderBy("feature_pos").collect()]
    assert got == [pytest.approx(0.04), None, None]
    kept = errors.squared_error(betas, predictions, missing_is_zero=False).orderBy("feature_pos").collect()
    assert kept[1].sq_err == pytest.approx(0.49)


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(80):
        case = i % 2 == 0
        for j in range(6):
            rows.append(("cases" if case else "controls", "d", i, j, float(rng.normal() + (3 if case and j == 4 else 0))))
    return spark.createDataFrame(rows, "cohort string, dataset string, sample_id int, feature_pos int, score double").cache()


def test_sweep_finds_the_signal_and_resumes(spark, separable, tmp_path):
    suite = evaluate.classifiers(trees=5, depth=3, rounds=2)
    sink = str(tmp_path / "sweep")
    models = {"RandomForest": suite["RandomForest"]}
    aucs, stable = study.classification(separable, n_splits=2, grid=(1, 2), models=models, sink=sink)
    rows = aucs.collect()
    assert sorted((r.fold, r.k) for r in rows) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert all(r.auc > 0.9 for r in rows)
    assert {r.feature_name for r in stable.where("rank = 1").collect()} == {"f4"}

    def broken():
        raise AssertionError("finished work must not be fitted again")

    again, _ = study.classification(separable, n_splits=2, grid=(1, 2), models={"RandomForest": broken}, sink=sink)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))

    perf = study.performance_table(aucs, n_resamples=50)
    assert perf.count() == 2 and perf.where("ci95_low <= auc_plot and auc_plot <= ci95_high").count() == 2


def test_every_classifier_fits(spark, separable):
    models = evaluate.classifiers(trees=3, depth=2, rounds=1)
    aucs, _ = study.classification(separable, n_splits=2, grid=(2,), models=models)
    rows = aucs.collect()
    assert {r.model for r in rows} == set(models) and all(r.auc > 0.8 for r in rows)


def test_study_chain(spark, separable):
    scores = study.scores(separable.withColumn("sq_err", F.abs("score") + 0.1).drop("score"))
    tests = study.feature_tests(scores)
    first = tests.first()
    assert first.feature_pos == 4 and first.fdr_bh < 0.01 and tests.count() == 6
    tables = study.distribution_tables(scores, tests)
    assert tables["density"].count() == 1024 and tables["medians"].count() == 6 and tables["boxes"].count() == 12
    summary = study.run_summary({"n": 1}, tests=tests)
    assert sorted(summary) == ["parameters", "tests"]


def test_outside_normalisation_controls(spark, separable):
    errs = separable.withColumn("sq_err", F.abs("score") + 0.1).drop("score")
    outside = errs.where("cohort = 'controls' and sample_id < 20")
    scores = study.scores(errs.where("sample_id >= 20"), outside)
    assert scores.select("sample_id").distinct().count() == 60 and scores.where("score is null").count() == 0
    pooled = study.scores(errs)
    means = pooled.where("cohort = 'controls'").groupBy("feature_pos").agg(F.avg("score").alias("m")).collect()
    assert [r.m for r in means] == pytest.approx([0.0] * 6, abs=1e-12)


def test_performance_without_bootstrap(spark):
    wide = spark.createDataFrame([(1, 0.5, 0.6), (2, 0.7, None)], "k int, A double, B double")
    perf = performance.combine(performance.mean_main([performance.melt_models(wide)]))
    best = {r.model: r for r in performance.best_and_mean(perf).collect()}
    assert (best["A"].best_auc, best["A"].best_k, best["B"].mean_auc) == (0.7, 2, 0.6)
    table = performance.best_mean_table(perf, ["A", "B"]).collect()
    assert [tuple(r) for r in table] == [("Best AUC", 0.7, 0.6), ("Mean AUC", 0.6, 0.6)]


def test_stages_are_written_in_the_shared_folder_and_can_be_dropped(spark, tmp_path, monkeypatch):
    assert module.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir", module.shared_folder(spark))
    monkeypatch.setattr(module, "shared_folder", lambda s: str(tmp_path))
    kept = module.stage(spark.range(5), "numbers")
    assert kept.count() == 5 and list(tmp_path.rglob("numbers-*/*.parquet"))
    module.drop_stages(spark)
    assert not list(tmp_path.rglob("*.parquet"))
