"""Classifier sweeps over the number of features, and the area under the ROC curve."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from probestats.operators import boosting
from probestats.operators.blocks import arrays_by_position
from probestats.operators.boosting import BinnedBoosting
from probestats.operators.ordered import running_totals
from probestats.operators.performance import model_columns
from probestats.operators.stage import free_driver, stage
from probestats.operators.trees import ExtraTrees

DEFAULT_GRID = range(1, 501)

#: MLlib's fits that run at once.
FITS = 1


def roc_auc(
    rows: DataFrame, by: Sequence[str] = (), *, score: str = "score", label: str = "label", hot_rows: int | None = None
) -> DataFrame:
    """Area under the ROC curve per group, ties counted half; NULL where one class is absent."""
    positive = F.when(F.col(label) == 1, 1).otherwise(0)
    steps, _ = running_totals(
        rows.where(F.col(score).isNotNull()), list(by), score, {"pos": positive, "neg": 1 - positive}, hot_rows=hot_rows
    )
    below = F.col("neg_cum") - F.col("neg") / F.lit(2.0)
    area = F.sum(F.col("pos") * below)
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    return steps.groupBy(*by).agg(
        F.max("pos_total").alias("n_pos"),
        F.max("neg_total").alias("n_neg"),
        F.when(pairs > 0, F.try_divide(area, pairs)).alias("auc"),
    )


def classifiers(seed: int = 42, trees: int = 100, depth: int = 30, rounds: int = 100) -> dict[str, Callable[[], Estimator | ExtraTrees | BinnedBoosting]]:
    """The classifier suite: MLlib's forest, its boosting, grown by a task where that can hold a fold, and randomised trees of our own.

    Names say what is fitted. MLlib's boosted trees always bin their features, so both boosting variants are
    binned ones. ``depth`` is at most 30, which is as deep as MLlib's trees go.
    """
    return {
        "RandomForest": lambda: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed),
        "BinnedBoostingDepth3": lambda: BinnedBoosting(rounds, depth=3, seed=seed),
        "BinnedBoostingDepth5": lambda: BinnedBoosting(rounds, depth=5, bins=256, seed=seed),
        "ExtraTrees": lambda: ExtraTrees(trees, depth, seed),
    }


def fold_vectors(
    rows: DataFrame, ranked: DataFrame, *, max_k: int, value: str = "score", missing: float = 0.0, sample: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """Per fold and sample, the values of that fold's ``max_k`` best features as one array, best first.

    rows: the ``sample`` columns, fold (the one that holds the sample out), label, feature_pos, value.
    """
    ranked = ranked.where(F.col("rank") <= max_k)
    size = ranked.groupBy(F.col("fold").alias("model_fold")).agg(F.max("rank").alias("_size"))
    chosen = ranked.select(F.col("fold").alias("model_fold"), "feature_pos", "rank")
    # at most max_k rows per fold
    values = rows.join(F.broadcast(chosen), "feature_pos").withColumn("_v", F.coalesce(value, F.lit(missing)))
    arrays = arrays_by_position(values, ["model_fold", *sample, "fold", "label"], F.col("rank") - 1, F.col("_v"), max_k)
    kept = F.transform(F.slice("values", F.lit(1), F.col("_size")), lambda x: F.coalesce(x, F.lit(missing)))
    return arrays.join(F.broadcast(size), "model_fold").select(
        "model_fold", *sample, "label", (F.col("fold") == F.col("model_fold")).alias("held_out"), kept.alias("values")
    )


def _score_column(predicted: DataFrame):
    column = "rawPrediction" if "rawPrediction" in predicted.columns else "probability"
    return F.element_at(vector_to_array(column), 2)


def k_sweep(
    vectors: DataFrame,
    *,
    folds: Sequence[int],
    grid: Sequence[int] = DEFAULT_GRID,
    models: dict[str, Callable[[], Estimator | ExtraTrees | BinnedBoosting]] | None = None,
    threads: int | None = None,
    sink: str | None = None,
) -> DataFrame:
    """AUC of every (fold, model, k): fit on the first k features of the fold, score its held-out samples.

    With ``sink``, each k is written to ``sink/k=<k>`` when done and found again after a restart; without it
    all held-out scores are one union, meant for short grids. ``threads`` of MLlib's fits run at once, by default
    ``FITS``: the driver holds all nodes of a forest while it grows.
    """
    models = models or classifiers()
    spark = vectors.sparkSession

    def held_out_scores(job: tuple[int, str, int]) -> DataFrame:
        fold, name, k = job
        data = vectors.where(F.col("model_fold") == fold).select(
            "label", "held_out", array_to_vector(F.slice("values", 1, k)).alias("features")
        )
        model = models[name]()
        fitted = (model.estimator() if isinstance(model, BinnedBoosting) else model).fit(data.where(~F.col("held_out")))
        predicted = fitted.transform(data.where("held_out"))
        scores = predicted.select(
            F.lit(fold).alias("fold"), F.lit(name).alias("model"), F.lit(k).alias("k"),
            "label", _score_column(predicted).alias("score"),
        )
        told = stage(scores, "scores")  # so that the model can go
        del model, fitted, predicted, scores
        free_driver(spark)
        return told

    def auc_of(ks: Sequence[int]) -> DataFrame:
        together = {name: model for name in models if isinstance(model := models[name](), ExtraTrees)}
        boosted = {name: model for name in models if isinstance(model := models[name](), BinnedBoosting)}
        cells = boosting.fits_in_tasks(vectors, folds, ks) if boosted else {}
        by_task = {(f, m) for f in folds for m, model in boosted.items() if f in cells and cells[f] <= model.few_cells}
        jobs = [(f, m, k) for k in ks for f in folds for m in models if m not in together]
        in_tasks, jobs = [j for j in jobs if j[:2] in by_task], [j for j in jobs if j[:2] not in by_task]
        with ThreadPoolExecutor(threads or FITS) as pool, ThreadPoolExecutor(len(together) + 1) as others:
            found = {name: others.submit(model.held_out_scores, vectors, folds, ks) for name, model in together.items()}  # all folds and sizes at once
            fitted = others.submit(lambda: [stage(boosting.held_out_scores(vectors, boosted, in_tasks), "boosted")] if in_tasks else [])
            parts = list(pool.map(held_out_scores, jobs))
            parts += fitted.result()
        for name, rows in found.items():
            parts.append(rows.result().select("fold", F.lit(name).alias("model"), "k", "label", "score"))
        scores = reduce(DataFrame.unionByName, parts)
        # written once: the models are not applied again by every pass of the AUC
        return roc_auc(stage(scores, "held_out"), ["fold", "model", "k"]).select("fold", "model", "k", "auc")

    if sink is None:
        return auc_of(grid)
    schema = "fold int, model string, k int, auc double"
    done = set()
    for k in grid:
        path = f"{sink.rstrip('/')}/k={k}"
        if not _finished(spark, path):
            auc_of([k]).drop("k").write.mode("overwrite").parquet(path)
        done.add(k)
    return spark.read.schema(schema).parquet(sink).where(F.col("k").isin(*done))


def _finished(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def mean_auc(fold_aucs: DataFrame, models: Sequence[str] | None = None, *, value: str = "auc") -> DataFrame:
    """Mean over folds, one row per k and one column per model."""
    return fold_aucs.groupBy("k").pivot("model", model_columns(fold_aucs, models)).agg(F.avg(value))
