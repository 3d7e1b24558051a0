"""Tables of classifier performance over k and model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from probestats.operators.describe import box_stats

BOOT = ("mean_auc_boot", "ci95_low", "ci95_high")


def melt_models(wide: DataFrame) -> DataFrame:
    """One column per model to (k, model, auc_main)."""
    models = [c for c in wide.columns if c != "k"]
    values = wide.select("k", *[F.col(m).cast("double").alias(m) for m in models])
    return values.unpivot(["k"], models, "model", "auc_main")


def mean_main(parts: Sequence[DataFrame]) -> DataFrame:
    """Mean AUC per (k, model) over several result tables."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("k", "model").agg(F.avg("auc_main").alias("auc_main"))


def mean_bootstrap(parts: Sequence[DataFrame]) -> DataFrame:
    rows = parts[0].select("k", "model", *BOOT)
    for part in parts[1:]:
        rows = rows.unionByName(part.select("k", "model", *BOOT))
    return rows.groupBy("k", "model").agg(*[F.avg(c).alias(c) for c in BOOT])


def combine(main: DataFrame, boot: DataFrame | None = None) -> DataFrame:
    """Main and bootstrap values side by side; ``auc_plot`` prefers the bootstrap mean."""
    if boot is None:
        joined = main.select("*", *[F.lit(None).cast("double").alias(c) for c in BOOT])
    else:
        joined = main.join(boot, ["k", "model"], "left")
    return joined.select("k", "model", "auc_main", *BOOT, F.coalesce("mean_auc_boot", "auc_main").alias("auc_plot"))


def auc_series(perf: DataFrame) -> DataFrame:
    """The curve per model, with its interval where both ends are known."""
    both = F.col("ci95_low").isNotNull() & F.col("ci95_high").isNotNull()
    return perf.select(
        "model", "k", "auc_plot", F.when(both, F.col("ci95_low")).alias("band_low"), F.when(both, F.col("ci95_high")).alias("band_high")
    ).orderBy("model", "k")


def model_columns(rows: DataFrame, models: Sequence[str] | None = None) -> list[str]:
    """The models to make columns of: those that occur, in order (read by a job), or the given ones.

    Raises if a model occurs that is not among the given ones, as its rows would be lost.
    """
    found = sorted(row[0] for row in rows.where(F.col("model").isNotNull()).select("model").distinct().collect())
    if models is None:
        return found
    if unlisted := set(found) - set(models):
        raise ValueError(f"models without a column: {sorted(unlisted)}")
    return list(models)


def heatmap(perf: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    return perf.groupBy("k").pivot("model", sorted(model_columns(perf, models))).agg(F.avg("auc_plot")).orderBy("k")


def model_boxes(perf: DataFrame) -> DataFrame:
    return box_stats(perf, "auc_plot", ["model"])


def best_and_mean(perf: DataFrame) -> DataFrame:
    """Best and mean AUC per model, and the smallest k that reaches the best."""
    return (
        perf.groupBy("model")
        .agg(
            F.max("auc_plot").alias("best_auc"),
            F.avg("auc_plot").alias("mean_auc"),
            F.max_by("k", F.struct("auc_plot", -F.col("k"))).alias("best_k"),
        )
        .orderBy(F.col("best_auc").desc(), "model")
    )


def best_mean_table(perf: DataFrame, models: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Two rows (best, mean), one column per model, rounded."""
    long = best_and_mean(perf).select(
        "model", F.explode(F.create_map(F.lit("Best AUC"), "best_auc", F.lit("Mean AUC"), "mean_auc")).alias("statistic", "auc")
    )
    return long.groupBy("statistic").pivot("model", model_columns(perf, models)).agg(F.round(F.first("auc"), digits)).orderBy("statistic")


def top_model_k(perf: DataFrame, n: int = 20) -> DataFrame:
    return (
        perf.orderBy(F.col("auc_plot").desc_nulls_last(), "model", "k")
        .limit(n)
        .select("model", "k", "auc_plot", "ci95_low", "ci95_high")
    )


