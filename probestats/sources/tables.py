"""Readers."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from probestats.functions.missing import nan_to_null
from probestats.operators.align import keep_first, number_features
from probestats.sources.lines import gene_set, matrix_fields

# Accepted separators, in the order they are tried, and file endings.
SEPARATORS = (",", "\t", ";", "|")
ENDINGS = ("csv", "tsv", "txt")


def find_by_stem(spark: SparkSession, root: str, stems: list[str]) -> DataFrame:
    """(stem, path) of the first matching file below ``root`` for each stem, by path order."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    )
    name = F.element_at(F.split("path", "/"), -1)
    pattern = rf"(?i)^(.*)\.({'|'.join(ENDINGS)})$"
    found = files.select("path", F.regexp_extract(name, pattern, 1).alias("stem")).where(F.col("stem").isin(stems))
    return found.groupBy("stem").agg(F.array_join(F.min(F.split("path", "/")), "/").alias("path"))


def line_order() -> list[Column]:
    """Sort keys that give back the line order of text files: file, split, line within the split."""
    return [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]


def _header(spark: SparkSession, path: str, id_column: str) -> tuple[str, list[str]]:
    first = spark.read.text(path).first()
    line = first[0].lstrip("\ufeff") if first else ""
    for sep in SEPARATORS:
        names = next(csv.reader([line], delimiter=sep), [])
        if id_column in names:
            return sep, names
    raise ValueError(f"{path} has no {id_column} column")


def read_matrix(spark: SparkSession, path: str, *, cohort: str, dataset: str, id_column: str = "CpG") -> tuple[DataFrame, DataFrame]:
    """A delimited matrix, features down and samples across.

    Returns (wide, samples): wide = cohort, dataset, cpg_id, values ARRAY<DOUBLE> with ids trimmed and the
    first of equal ids kept; samples = cohort, dataset, sample_ids. What is not a number becomes NULL.

    A line is split into one array, not into a column per sample, so that the plan stays small for any
    number of samples. Quoted fields may contain the separator; a line with more fields than the header raises.
    """
    sep, names = _header(spark, path, id_column)
    at = names.index(id_column)
    order = [f"_line{i}" for i in range(3)]
    lines = spark.read.text(path).select(*[c.alias(n) for c, n in zip(line_order(), order)], "value")
    split = lines.select(*order, matrix_fields(F.col("value"), sep, names).alias("_cells"))
    others = F.concat(F.slice("_cells", 1, at), F.slice("_cells", at + 2, len(names)))
    rows = split.select(
        *order,
        F.get("_cells", F.lit(at)).alias("cpg_id"),
        F.transform(others, lambda x: nan_to_null(x.try_cast("double"))).alias("values"),
    )
    kept = rows.where(F.col("cpg_id").isNotNull() & ~F.col("cpg_id").isin("", id_column, "\ufeff" + id_column))
    tagged = keep_first(kept, ["cpg_id"], order).select(
        F.lit(cohort).alias("cohort"), F.lit(dataset).alias("dataset"), "cpg_id", "values"
    )
    sample_ids = [n for i, n in enumerate(names) if i != at]
    samples = spark.createDataFrame([(cohort, dataset, sample_ids)], "cohort string, dataset string, sample_ids array<string>")
    return tagged, samples


def read_manifest(spark: SparkSession, path: str, *, id_column: str = "CpG") -> DataFrame:
    """Annotation CSV with ``cpg_id`` and ``feature_pos`` (0-based line order, first of equal ids) added."""
    lines = spark.read.options(header="true").csv(path)
    if id_column not in lines.columns:
        raise ValueError(f"{path} has no {id_column} column")
    file, block, line = line_order()
    placed = lines.select("*", F.col(id_column).alias("cpg_id"), file.alias("_file"), block.alias("_block"), line.alias("_line"))
    numbered = number_features(placed, F.col("_line"), cells=[F.col("_file"), F.col("_block")])
    return numbered.drop("_file", "_block", "_line")


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """GMT text: term, description, genes. Output: term, gene, term_order; empty names dropped."""
    term, genes = gene_set(F.col("value"))
    lines = spark.read.text(path).select(term.alias("term"), genes.alias("genes"), F.monotonically_increasing_id().alias("term_order"))
    return lines.select("term", F.explode("genes").alias("gene"), "term_order")


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the given schema where nothing has been written."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def select_datasets(rows: DataFrame, cases: list[str], controls: list[str]) -> DataFrame:
    """Rows of the named datasets per cohort; on a table partitioned by both, other folders are not read."""
    if not cases or not controls:
        raise ValueError("name at least one dataset of each cohort")
    cohort, dataset = F.col("cohort"), F.col("dataset")
    return rows.where(((cohort == "cases") & dataset.isin(cases)) | ((cohort == "controls") & dataset.isin(controls)))


def shared_features(rows: DataFrame) -> DataFrame:
    """Rows of the features that both cohorts have."""
    def of(cohort: str) -> DataFrame:
        return rows.where(F.col("cohort") == cohort).select("feature_pos").distinct()

    return rows.join(of("cases").intersect(of("controls")), "feature_pos", "left_semi")
