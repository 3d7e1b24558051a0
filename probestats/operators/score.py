"""From squared errors to scores: fill or block, normalise by sample, compare with controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from probestats.functions.keys import block_of
from probestats.functions.missing import fill_missing, finite_or_null, mask_missing
from probestats.operators.ordered import exact_quantiles, join_lookup

SAMPLE = ("cohort", "dataset", "sample_id")


def block_mean(
    errors: DataFrame,
    *,
    value: str = "sq_err",
    sample: Sequence[str] = SAMPLE,
    group_size: int = 1,
    fill: float = 1.0,
    sentinels: tuple[float, ...] = (0.0, -1.0),
) -> DataFrame:
    """Mean of ``group_size`` consecutive features, missing entries skipped, an empty block filled.

    A block of one is the filled value itself and needs no shuffle.
    """
    kept = [*sample, block_of(F.col("feature_pos"), group_size).alias("feature_pos")]
    if group_size == 1:
        return errors.select(*kept, fill_missing(F.col(value), fill, sentinels).alias(value))
    masked = errors.select(*kept, mask_missing(F.col(value), sentinels).alias(value))
    return masked.groupBy(*sample, "feature_pos").agg(F.coalesce(F.avg(value), F.lit(fill)).alias(value))


def median_normalize(rows: DataFrame, *, value: str = "sq_err", sample: Sequence[str] = SAMPLE) -> DataFrame:
    """Divide by the sample's median; a median of 0 and infinite results become NULL."""
    medians = exact_quantiles(rows, sample, value, {"_median": 0.5}).select(
        *sample, F.nullif(F.col("_median"), F.lit(0.0)).alias("_median"), F.col("n").alias("_n")
    )
    scaled = finite_or_null(F.try_divide(F.col(value), F.col("_median")))
    return join_lookup(rows, medians, sample, size="_n").withColumn(value, scaled).drop("_median")


def control_baseline(controls: DataFrame, *, value: str = "sq_err") -> DataFrame:
    """Mean and sample deviation of each feature over all given control samples.

    One control gives a NULL deviation, as it has no spread.
    """
    return controls.groupBy("feature_pos").agg(
        F.avg(value).alias("ctrl_mean"), F.stddev_samp(value).alias("ctrl_std")
    )


def rec_score(rows: DataFrame, baseline: DataFrame, *, value: str = "sq_err", std_offset: float = 1.0) -> DataFrame:
    """Distance from the control mean in (deviation + offset). Features without a baseline score NULL.

    The baseline has one row per feature; Spark broadcasts it when its measured size allows.
    """
    z = F.try_divide(F.col(value) - F.col("ctrl_mean"), F.col("ctrl_std") + F.lit(std_offset))
    return rows.join(baseline, "feature_pos", "left").withColumn("score", z).drop(value, "ctrl_mean", "ctrl_std")
