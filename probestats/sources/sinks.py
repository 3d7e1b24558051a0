"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from probestats.functions.keys import block_of

FILE_FEATURES = 10_000


def write_matrix(rows: DataFrame, path: str) -> None:
    """Long or blocked matrix as Parquet by cohort and dataset; only the datasets at hand are replaced.

    Rows are dealt by dataset and range of features, so that a dataset has a file for each range at most, and
    sorted by feature within it, so that feature ranges prune row groups.
    """
    place = "feature_pos" if "feature_pos" in rows.columns else "segment_id"
    part = block_of(F.col(place), FILE_FEATURES) if place == "feature_pos" else F.col(place)
    (
        rows.repartition("cohort", "dataset", part)
        .sortWithinPartitions("cohort", "dataset", place)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("cohort", "dataset")
        .parquet(path)
    )


def write_bucketed(rows: DataFrame, table: str, *, buckets: int, path: str | None = None) -> DataFrame:
    """Long matrix as a table of ``buckets`` buckets by feature, each sorted by it. Returns the table as it is read.

    Tables of one number of buckets join by feature, and aggregate by it, where their buckets lie: betas, errors, scores
    and baselines meet without an exchange. Joins on sample and feature do so as well if the session has
    ``spark.sql.requireAllClusterKeysForCoPartition`` off. ``path`` places the table outside of the warehouse.
    """
    # dealt as the buckets are, so that a bucket is one file
    writer = rows.repartition(buckets, "feature_pos").write.mode("overwrite").format("parquet").bucketBy(buckets, "feature_pos").sortBy("feature_pos")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return rows.sparkSession.table(table)


def write_table(rows: DataFrame, path: str, *, export: bool = False) -> None:
    """Result table: Parquet, or CSV with a header for export."""
    writer = rows.write.mode("overwrite")
    if export:
        writer.option("header", "true").csv(path)
    else:
        writer.parquet(path)


def append_run(rows: DataFrame, path: str, **partition: str | int) -> None:
    """Add one run's rows under its own partition folder, replacing an earlier run of the same name."""
    folders = "/".join(f"{k}={v}" for k, v in partition.items())
    rows.drop(*partition).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{folders}")


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def export_betas(betas: DataFrame) -> DataFrame:
    """Export form of betas: missing as 0, 32-bit floats."""
    return betas.withColumn("beta", F.coalesce("beta", F.lit(0.0)).cast("float"))
