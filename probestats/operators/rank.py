"""Feature ranking on the training side of each fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from probestats.functions.keys import feature_name


def fold_moments(rows: DataFrame, *, value: str = "score", n_splits: int = 5) -> DataFrame:
    """Count, mean and squared deviations of each class per feature, over every fold's training samples.

    rows: feature_pos, fold, label, value. The data is aggregated once per (feature, fold, label); the
    training set of a fold is then put together from the other folds' few numbers.
    """
    parts = rows.groupBy("feature_pos", "fold", "label").agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("ss")
    )
    trained = F.filter(F.sequence(F.lit(1), F.lit(n_splits)), lambda f: f != F.col("fold"))
    spread = parts.where(F.col("n") > 0).select("feature_pos", "label", "n", "m", "ss", F.explode(trained).alias("fold"))

    def of_class(label: int, c: str) -> Column:
        return F.when(F.col("label") == label, F.col(c))

    sums = spread.groupBy("fold", "feature_pos").agg(
        *[F.coalesce(F.sum(of_class(c, "n")), F.lit(0)).alias(f"n{c}") for c in (0, 1)],
        *[F.sum(of_class(c, "n") * F.col("m")).alias(f"_sum{c}") for c in (0, 1)],
        *[F.sum(of_class(c, "ss")).alias(f"_ss{c}") for c in (0, 1)],
        # at most n_splits - 1 entries per class
        *[F.collect_list(F.when(F.col("label") == c, F.struct("n", "m"))).alias(f"_parts{c}") for c in (0, 1)],
    )
    means = sums.select("*", *[F.try_divide(F.col(f"_sum{c}"), F.col(f"n{c}")).alias(f"mean{c}") for c in (0, 1)])

    def deviations(c: int) -> Column:
        between = F.aggregate(
            F.col(f"_parts{c}"),
            F.lit(0.0),
            lambda acc, e: acc + e["n"] * (e["m"] - F.col(f"mean{c}")) * (e["m"] - F.col(f"mean{c}")),
        )
        return F.col(f"_ss{c}") + between

    return means.select("fold", "feature_pos", "n0", "n1", "mean0", "mean1", deviations(0).alias("ss0"), deviations(1).alias("ss1"))


def passes_ratio(threshold: float = 0.01) -> Column:
    """Keep features whose case mean exceeds the control mean by the given share."""
    reached = F.col("mean1") >= F.lit(1.0 + threshold) * F.greatest("mean0", F.lit(1e-12))
    # a mean that is NaN or missing compares with nothing
    return F.coalesce(reached & ~F.isnan("mean0") & ~F.isnan("mean1") & F.col("mean0").isNotNull(), F.lit(False))


def anova_f() -> Column:
    """F of two classes; infinite if there is no spread within them, NULL if there is none at all."""
    n = F.col("n0") + F.col("n1")
    grand = (F.col("n0") * F.col("mean0") + F.col("n1") * F.col("mean1")) / n
    between = (
        F.col("n0") * (F.col("mean0") - grand) * (F.col("mean0") - grand)
        + F.col("n1") * (F.col("mean1") - grand) * (F.col("mean1") - grand)
    )
    within = F.try_divide(F.col("ss0") + F.col("ss1"), n - 2)
    return F.when((within == 0) & (between > 0), F.lit(float("inf"))).otherwise(F.try_divide(between, within))


def rank_features(moments: DataFrame, *, top: int, ratio_threshold: float | None = None) -> DataFrame:
    """The ``top`` features of each fold by F; features whose F is missing or NaN come last; ties by position.

    Spark keeps only ``top`` rows per fold and map task before the shuffle.
    """
    kept = moments if ratio_threshold is None else moments.where(passes_ratio(ratio_threshold))
    scored = kept.select(
        "fold", "feature_pos", F.coalesce(F.nanvl(anova_f(), F.lit(float("-inf"))), F.lit(float("-inf"))).alias("f_stat")
    )
    order = W.partitionBy("fold").orderBy(F.col("f_stat").desc(), "feature_pos")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def stability_table(ranked: DataFrame, top: int = 20) -> DataFrame:
    return ranked.where(F.col("rank") <= top).select(
        "fold", "rank", feature_name(F.col("feature_pos")).alias("feature_name"), F.col("feature_pos").alias("feature_index")
    )
