"""Manifest alignment and duplicate handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from probestats.functions.keys import strip
from probestats.functions.missing import nan_to_null
from probestats.operators.ordered import exact_quantiles, join_lookup, row_ranks


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row of each key by ``order``.

    The ``= 1`` filter on row_number lets Spark cut every map task down to one row per key before the
    shuffle, so a key with very many copies does not meet in one task.
    """
    return (
        rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
        .where(F.col("_nth") == 1)
        .drop("_nth")
    )


def resolve_duplicates(rows: DataFrame, keys: Sequence[str], value: str, how: str = "mean") -> DataFrame:
    """One value per key: the mean or the exact median of its copies, missing ones skipped."""
    if how == "mean":
        return rows.groupBy(*keys).agg(F.avg(value).alias(value))
    if how == "median":
        found = exact_quantiles(rows, keys, value, {value: 0.5}, small_groups=True).select(*keys, value)
        return rows.select(*keys).distinct().join(found, list(keys), "left")
    raise ValueError(f"unknown way to resolve duplicates: {how}")


def number_features(features: DataFrame, order: Column, cells: Sequence[Column] | None = None) -> DataFrame:
    """Manifest rows with trimmed unique ids (first one wins) and their position from 0.

    ``cells`` are coarse order keys (such as file and split) that let the numbering run in parallel; their
    number is that of the splits of one file.
    """
    named = features.withColumn("cpg_id", strip(F.col("cpg_id")))
    cell_names = [f"_cell{i}" for i in range(len(cells or ()))]
    named = named.select("*", order.alias("_order"), *[c.alias(n) for c, n in zip(cells or (), cell_names)])
    first = keep_first(named, ["cpg_id"], [*cell_names, "_order"])
    ranked = row_ranks(first, [], "_order", ["cpg_id"], cells=None if cells is None else [F.col(c) for c in cell_names], few_cells=cells is not None)
    return ranked.withColumn("feature_pos", (F.col("row_rank") - 1).cast("int")).drop("row_rank", "_order", *cell_names)


def align_to_manifest(wide: DataFrame, samples: DataFrame, features: DataFrame) -> DataFrame:
    """Long matrix with one row per manifest feature and sample, NULL where the input has nothing.

    wide:     cohort, dataset, cpg_id, values  (one array entry per sample of the dataset; ids unique)
    samples:  cohort, dataset, sample_ids      (one row per dataset, entries in the same order)
    features: feature_pos, cpg_id

    Rows stay one array per feature through the join and are unfolded after it, so what is shuffled is
    the input, not the dense result.
    """
    known = features.select("feature_pos", "cpg_id")
    present = (
        wide.select("cohort", "dataset", F.col("cpg_id"), "values")
        .join(known, "cpg_id")
        .select("cohort", "dataset", "feature_pos", "values")
    )
    # every dataset carries every manifest position; datasets are files, so their list is a short array
    names = samples.agg(F.collect_set(F.struct("cohort", "dataset")))
    places = known.select("feature_pos", F.explode(names.scalar()).alias("_set")).select(
        "_set.cohort", "_set.dataset", "feature_pos"
    )
    # a dataset is one key here, with a row for each feature: a large one meets a broadcast of its sample ids
    whole = places.join(present, ["cohort", "dataset", "feature_pos"], "left")
    sized = samples.withColumn("_n", known.agg(F.count(F.lit(1))).scalar())
    joined = join_lookup(whole, sized, ["cohort", "dataset"], size="_n")
    cells = F.transform(
        F.col("sample_ids"),
        lambda s, i: F.struct(s.alias("sample_id"), F.get(F.col("values"), i).alias("beta")),
    )
    return joined.select("cohort", "dataset", "feature_pos", F.explode(cells).alias("_cell")).select(
        "cohort",
        "dataset",
        F.col("_cell.sample_id").alias("sample_id"),
        "feature_pos",
        nan_to_null(F.col("_cell.beta")).alias("beta"),
    )


def value_range(rows: DataFrame, value: str = "beta", fill: float = 0.0) -> DataFrame:
    """Smallest and largest value once missing entries are filled."""
    filled = F.coalesce(F.col(value), F.lit(fill))
    return rows.agg(F.min(filled).alias("min_value"), F.max(filled).alias("max_value"))
