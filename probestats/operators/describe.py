"""Distributions behind figures: histograms, box statistics, medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from probestats.functions.missing import finite_or_null
from probestats.operators.fdr import top_tests
from probestats.operators.ordered import exact_quantiles, join_lookup, null_safe_join


def _with_every_bin(counts: DataFrame, by: Sequence[str], bins: int, carried: Sequence[str] = ()) -> DataFrame:
    """Bins that no value fell into appear with count 0. ``counts`` has one row per group and bin."""
    groups = counts.select(*by, *carried).distinct()
    spine = groups.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    found = counts.select(*by, "bin", "n")
    return null_safe_join(spine, found, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """1..bins over [low, high], right end closed; 0 or less and more than bins outside."""
    width = (high - low) / bins
    return F.when(value == high, F.lit(bins)).otherwise(F.floor((value - low) / width) + 1).cast("int")


def density_histogram(
    rows: DataFrame,
    value: str = "score",
    *,
    by: Sequence[str] = ("cohort",),
    bins: int = 512,
    low: float = -1.0,
    high: float = 3.0,
    clip: float | None = None,
) -> DataFrame:
    """Density per bin of a fixed range; values outside are left out of the total too."""
    usable = rows.select(*by, finite_or_null(F.col(value).cast("double")).alias("_v"))
    inside = usable.where((F.col("_v") >= low) & (F.col("_v") <= high))
    counts = inside.groupBy(*by, _bin(F.col("_v"), F.lit(low), F.lit(high), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    width = (high - low) / bins
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    full = null_safe_join(_with_every_bin(counts, by, bins), totals, list(by))
    density = F.col("n") / (F.col("_total") * F.lit(width))
    if clip is not None:
        density = F.greatest(density, F.lit(clip))
    center = F.lit(low) + (F.col("bin") - F.lit(0.5)) * F.lit(width)
    return full.select(*by, "bin", center.alias("center"), "n", density.alias("density"))


def range_histogram(rows: DataFrame, value: str, *, by: Sequence[str] = ("cohort", "dataset"), bins: int = 100) -> DataFrame:
    """Counts in equal bins between each group's smallest and largest value."""
    usable = rows.select(*by, finite_or_null(F.col(value).cast("double")).alias("_v")).where(F.col("_v").isNotNull())
    ends = usable.groupBy(*by).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    # a single value gets a range of width 1 around it
    half = F.when(F.col("_lo") == F.col("_hi"), 0.5).otherwise(0.0)
    ends = ends.select(*by, (F.col("_lo") - half).alias("low"), (F.col("_hi") + half).alias("high"), "_n")
    binned = join_lookup(usable, ends, by, size="_n")
    counts = binned.groupBy(*by, "low", "high", _bin(F.col("_v"), F.col("low"), F.col("high"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    left = F.col("low") + (F.col("bin") - 1) * (F.col("high") - F.col("low")) / bins
    return _with_every_bin(counts, by, bins, ("low", "high")).select(*by, "bin", left.alias("left_edge"), "n")


def box_stats(rows: DataFrame, value: str, by: Sequence[str], *, whisker: float = 1.5) -> DataFrame:
    """Quartiles, and whiskers that end at the outermost value within ``whisker`` interquartile ranges."""
    box = exact_quantiles(rows, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = F.lit(whisker) * (F.col("q3") - F.col("q1"))
    data = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    inside = join_lookup(data, box, by, size="n")
    ends = inside.groupBy(*by).agg(
        F.min(F.when(F.col("_v") >= F.col("q1") - reach, F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_v") <= F.col("q3") + reach, F.col("_v"))).alias("_hi"),
    )
    return null_safe_join(box, ends, list(by)).select(
        *by,
        "n",
        "q1",
        "median",
        "q3",
        F.least("_lo", "q1").alias("whisker_low"),
        F.greatest("_hi", "q3").alias("whisker_high"),
    )


def feature_medians(rows: DataFrame, value: str = "score", *, cohorts: Sequence[str] = ("cases", "controls")) -> DataFrame:
    """Median of each feature, one column per cohort."""
    medians = exact_quantiles(rows, ["feature_pos", "cohort"], value, {"median": 0.5})
    wide = medians.groupBy("feature_pos").pivot("cohort", list(cohorts)).agg(F.first("median"))
    for c in cohorts:
        wide = wide.withColumnRenamed(c, f"median_{c}")
    return wide


def top_feature_boxes(rows: DataFrame, tests: DataFrame, value: str = "score", *, n: int = 10) -> DataFrame:
    """Box statistics per cohort of the ``n`` features with the smallest p."""
    chosen = top_tests(tests, n).select("feature_pos")
    return box_stats(rows.join(F.broadcast(chosen), "feature_pos", "left_semi"), value, ["feature_pos", "cohort"])
