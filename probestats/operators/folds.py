"""Folds, samples without replacement, bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from probestats.functions.draws import draw32, draw_cell, draw_key
from probestats.operators.ordered import row_ranks


def assign_folds(
    samples: DataFrame, *, label: str = "label", key: str | Sequence[str] = "sample_id", n_splits: int = 5, seed: int = 42
) -> DataFrame:
    """Stratified shuffled folds: each label is dealt out in hash order, so sizes differ by at most one.

    ``key`` names the column or columns that tell samples apart.
    """
    keys = [key] if isinstance(key, str) else list(key)
    shuffled = samples.withColumn("_draw", draw_key(seed, *[F.col(k) for k in keys]))
    ranked = row_ranks(shuffled, [label], "_draw", keys, cells=[draw_cell(F.col("_draw"))], few_cells=True)
    return ranked.withColumn("fold", ((F.col("row_rank") - 1) % n_splits + 1).cast("int")).drop("_draw", "row_rank")


def capped_sample(rows: DataFrame, n: int, keys: Sequence[str], *, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer) without replacement, the same ones on every run."""
    shuffled = rows.withColumn("_draw", draw_key(seed, *[F.col(k) for k in keys]))
    cells = [draw_cell(F.col("_draw"))]
    return row_ranks(shuffled, [], "_draw", list(keys), limit=n, cells=cells, few_cells=True).drop("_draw", "row_rank")


def _at(sorted_means: Column, n: int, q: float) -> Column:
    spot = q * (n - 1)
    low = int(spot)
    below = F.element_at(sorted_means, low + 1)
    above = F.element_at(sorted_means, min(low + 2, n))
    return below + (above - below) * F.lit(spot - low)


def bootstrap_ci(
    fold_aucs: DataFrame,
    *,
    by: Sequence[str] = ("k", "model"),
    fold: str = "fold",
    value: str = "auc",
    n_resamples: int = 1000,
    alpha: float = 0.05,
    seed: int = 42,
) -> DataFrame:
    """Mean of resampled fold means and its alpha/2 and 1 - alpha/2 quantiles per group.

    One value per fold goes into a group (copies are averaged), so a group's array is as long as there are
    folds; resampling then happens inside the row.
    """
    per_fold = fold_aucs.groupBy(*by, fold).agg(F.avg(value).alias("_auc")).where(F.col("_auc").isNotNull())
    grouped = per_fold.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(fold), F.col("_auc")))), lambda e: e["_auc"]).alias("_aucs")
    )
    size = F.size("_aucs")

    def one_mean(rep: Column) -> Column:
        picks = F.transform(
            F.sequence(F.lit(1), size),
            lambda d: F.get(F.col("_aucs"), (draw32(seed, *[F.col(c) for c in by], rep, d) % size).cast("int")),
        )
        return F.aggregate(picks, F.lit(0.0), lambda acc, x: acc + x) / size

    means = grouped.select(
        *by, F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(n_resamples)), one_mean)).alias("_means")
    )
    total = F.aggregate("_means", F.lit(0.0), lambda acc, x: acc + x)
    return means.select(
        *by,
        (total / n_resamples).alias("mean_auc_boot"),
        _at(F.col("_means"), n_resamples, alpha / 2).alias("ci95_low"),
        _at(F.col("_means"), n_resamples, 1 - alpha / 2).alias("ci95_high"),
    )
