"""Reconstruction errors: the forward pass of segment networks and the error summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from probestats.functions.keys import block_of
from probestats.functions.missing import is_missing, nan_to_null
from probestats.operators.blocks import arrays_by_position
from probestats.operators.ordered import exact_quantiles, null_safe_join

SEGMENT_WIDTH = 10_000
SAMPLES_PER_TASK = 500
SAMPLES_PER_STEP = 500
DATASET = ("cohort", "dataset")
SAMPLE = ("cohort", "dataset", "sample_id")


def to_blocks(betas: DataFrame, *, value: str = "beta", width: int = SEGMENT_WIDTH) -> DataFrame:
    """Long matrix to one array per sample and segment: a value stands at its feature's place in the segment.

    Arrays of a segment all end with its last feature that any sample has; absent features are NULL. A
    (sample, feature) given twice raises.
    """
    segment, place = block_of(F.col("feature_pos"), width), F.col("feature_pos") % width
    segments = betas.groupBy(segment.alias("segment_id")).agg((F.max(place) + 1).cast("int").alias("_size"))
    blocks = arrays_by_position(betas.withColumn("segment_id", segment), [*SAMPLE, "segment_id"], place, F.col(value), width)
    # one row per segment: features / segment width
    return blocks.join(F.broadcast(segments), "segment_id").select(*SAMPLE, "segment_id", F.slice("values", F.lit(1), F.col("_size")).alias("values"))


def to_long(blocks: DataFrame, *, values: str = "values", value: str = "beta", width: int = SEGMENT_WIDTH) -> DataFrame:
    keys = [c for c in blocks.columns if c not in (values, "segment_id")]
    return blocks.select(*keys, "segment_id", F.posexplode(values).alias("_pos", value)).select(
        *keys, (F.col("segment_id") * width + F.col("_pos")).cast("int").alias("feature_pos"), value
    )


def _forward(x: np.ndarray, layers: list[dict]) -> np.ndarray:
    for layer in layers:
        x = x @ layer["weight"].T + layer["bias"]
        if layer["activation"] == "sigmoid":
            x = 1.0 / (1.0 + np.exp(-x))
        else:
            x = np.maximum(x, 0.0)
        if layer["scale"] is not None:
            x = x * layer["scale"] + layer["shift"]
    return x


def _read_layers(weights: pd.DataFrame) -> list[dict]:
    layers = []
    for row in weights.sort_values("layer").itertuples(index=False):
        bias = np.asarray(row.bias, dtype=np.float64)
        scale = shift = None
        if row.bn_var is not None:
            scale = np.asarray(row.bn_gamma, dtype=np.float64) / np.sqrt(np.asarray(row.bn_var, dtype=np.float64) + row.bn_eps)
            shift = np.asarray(row.bn_beta, dtype=np.float64) - np.asarray(row.bn_mean, dtype=np.float64) * scale
        layers.append(
            {
                "weight": np.asarray(row.weight, dtype=np.float64).reshape(len(bias), -1),
                "bias": bias,
                "activation": row.activation,
                "scale": scale,
                "shift": shift,
            }
        )
    return layers


def reconstruct(
    blocks: DataFrame,
    weights: DataFrame,
    *,
    samples_per_task: int = SAMPLES_PER_TASK,
    half_precision: bool = False,
) -> DataFrame:
    """Squared reconstruction error per position; NULL where the input is missing (NULL or 0).

    blocks:  sample keys, segment_id, values ARRAY
    weights: segment_id, layer INT, activation ('relu' or 'sigmoid'), weight ARRAY (row-major, outputs first),
             bias ARRAY, bn_gamma, bn_beta, bn_mean, bn_var ARRAY or NULL, bn_eps DOUBLE

    Samples of one segment are spread over enough groups that none holds much more than
    ``samples_per_task`` arrays; each group gets its own copy of that segment's weights. Segments without
    weights give NULL errors. ``half_precision`` rounds inputs, predictions and errors to 16 bits.
    """
    per_segment = blocks.groupBy("segment_id").agg(F.count(F.lit(1)).alias("_n"))
    spread = F.broadcast(
        per_segment.select("segment_id", F.ceil(F.col("_n") / samples_per_task).cast("int").alias("_parts"))
    )
    # one row per segment: features / segment width
    left = blocks.join(spread, "segment_id").withColumn(
        "_part", F.pmod(F.xxhash64(*SAMPLE), F.col("_parts")).cast("int")
    ).drop("_parts")
    right = weights.join(spread, "segment_id").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    ).drop("_parts")
    columns = [*SAMPLE, "segment_id"]
    schema = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in columns) + ", sq_errs array<double>"

    def score(samples: pd.DataFrame, layers: pd.DataFrame) -> pd.DataFrame:
        out = samples[columns].copy()
        if samples.empty:
            return out.assign(sq_errs=pd.Series(dtype=object))
        net = None if layers.empty else _read_layers(layers)
        arrays = samples["values"].tolist()
        steps = [arrays[s : s + SAMPLES_PER_STEP] for s in range(0, len(arrays), SAMPLES_PER_STEP)]
        out["sq_errs"] = [row for step in steps for row in errors_of(np.stack(step).astype(np.float64), net)]
        return out

    def errors_of(x: np.ndarray, net: list[dict] | None) -> np.ndarray:
        if half_precision:
            x = x.astype(np.float16).astype(np.float64)
        missing = np.isnan(x) | (x == 0)
        if net is None:
            return np.full(x.shape, np.nan)
        # a last segment may end before its network does: what it lacks counts as missing
        more = max(0, net[0]["weight"].shape[1] - x.shape[1])
        predicted = _forward(np.pad(np.where(missing, 0.0, x), ((0, 0), (0, more))), net)[:, : x.shape[1]]
        if half_precision:
            predicted = predicted.astype(np.float16).astype(np.float64)
        found = (predicted - x) ** 2
        if half_precision:
            found = found.astype(np.float16).astype(np.float64)
        found[missing] = np.nan
        return found

    scored = (
        left.groupBy("segment_id", "_part")
        .cogroup(right.groupBy("segment_id", "_part"))
        .applyInPandas(score, schema)
    )
    return scored.withColumn("sq_errs", F.transform("sq_errs", nan_to_null))


def squared_error(betas: DataFrame, predictions: DataFrame, *, missing_is_zero: bool = True) -> DataFrame:
    """(prediction - beta)^2 where both are known, NULL otherwise."""
    known = ~is_missing(F.col("beta"), (0.0,) if missing_is_zero else ())
    error = F.when(known, F.pow(F.col("prediction") - F.col("beta"), F.lit(2.0)))
    keys = [*SAMPLE, "feature_pos"]
    return betas.join(predictions.select(*keys, "prediction"), keys, "left").select(*keys, error.alias("sq_err"))


def error_metrics(errors: DataFrame, *, by: Sequence[str] = DATASET) -> DataFrame:
    """Missing share, MSE, MAE, RMSE, median and 95th percentile of the absolute error per dataset."""
    absolute = errors.withColumn("_ae", F.sqrt("sq_err"))
    sums = absolute.groupBy(*by).agg(
        (F.lit(100.0) * F.count_if(F.col("sq_err").isNull()) / F.count(F.lit(1))).alias("missing_pct"),
        F.avg("sq_err").alias("mse_global"),
        F.avg("_ae").alias("mae_global"),
        F.sqrt(F.avg("sq_err")).alias("rmse_global"),
    )
    spots = exact_quantiles(absolute, by, "_ae", {"median_ae": 0.5, "p95_ae": 0.95}).drop("n")
    return null_safe_join(sums, spots, list(by), "left")


def segment_means(errors: DataFrame, *, by: Sequence[str] = DATASET, width: int = SEGMENT_WIDTH) -> DataFrame:
    segment = block_of(F.col("feature_pos"), width).alias("segment_id")
    return errors.groupBy(*by, segment).agg(F.avg("sq_err").alias("mse_segment"))


def error_summary(
    errors: DataFrame, n_segments: int | None = None, *, by: Sequence[str] = DATASET, width: int = SEGMENT_WIDTH
) -> DataFrame:
    """One wide row per dataset: the metrics and MSE_Segment_1..n, up to the last segment there is (read by a job).

    Raises if ``n_segments`` is given and there are more.
    """
    there = errors.agg(F.max(block_of(F.col("feature_pos"), width))).first()[0]
    there = 0 if there is None else int(there) + 1
    if n_segments is not None and there > n_segments:
        raise ValueError(f"{there} segments, {n_segments} columns")
    n_segments = there if n_segments is None else n_segments
    wide = (
        segment_means(errors, by=by, width=width)
        .groupBy(*by)
        .pivot("segment_id", list(range(n_segments)))
        .agg(F.first("mse_segment"))
    )
    for i in range(n_segments):
        wide = wide.withColumnRenamed(str(i), f"mse_segment_{i + 1}")
    return null_safe_join(error_metrics(errors, by=by), wide, list(by))


def missing_share(rows: DataFrame, value: str, *, by: Sequence[str] = DATASET, zero_is_missing: bool = True) -> DataFrame:
    missing = is_missing(F.col(value), (0.0, -1.0) if zero_is_missing else ())
    return rows.groupBy(*by).agg(
        F.count_if(missing).alias("n_missing"),
        F.count(F.lit(1)).alias("n_total"),
        (F.lit(100.0) * F.count_if(missing) / F.count(F.lit(1))).alias("missing_pct"),
    )


def check_matrix(rows: DataFrame, weights: DataFrame | None = None, *, n_features: int, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Samples whose feature count is not the expected one, and segments that no model covers."""
    counts = rows.groupBy(*SAMPLE).agg(F.count(F.lit(1)).alias("n_found"))
    bad = counts.where(F.col("n_found") != n_features).select(
        F.lit("feature_count").alias("problem"), F.concat_ws("/", *SAMPLE).alias("subject"), "n_found"
    )
    if weights is None:
        return bad
    segments = rows.groupBy(block_of(F.col("feature_pos"), width).alias("segment_id")).agg(
        F.count(F.lit(1)).alias("n_found")
    )
    uncovered = segments.join(weights.select("segment_id").distinct(), "segment_id", "left_anti").select(
        F.lit("segment_without_model").alias("problem"), F.col("segment_id").cast("string").alias("subject"), "n_found"
    )
    return bad.unionByName(uncovered)
