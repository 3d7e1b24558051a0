"""The study's inputs as seen in the given star-schema tables.

embeddings: a numeric matrix (one sample per vector; labels below 5 are cases).  lineitem: a larger
two-group sample and a feature-to-gene relation.  part: the manifest.  supplier and nation: gene sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from probestats.functions.keys import case_label


GENES = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long matrix: cohort, dataset, sample_id, label, feature_pos, value."""
    return table(spark, sf_dir, "embeddings").select(
        F.when(F.col("label") < 5, "cases").otherwise("controls").alias("cohort"),
        F.concat(F.lit("ds_"), F.col("label")).alias("dataset"),
        F.col("vec_id").alias("sample_id"),
        F.posexplode("embedding").alias("feature_pos", "_v"),
    ).select("cohort", "dataset", "sample_id", case_label(F.col("cohort")).alias("label"), "feature_pos", F.col("_v").cast("double").alias("value"))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared values with the three missing markers (0, -1, NULL) spread in by rule."""
    marker = (F.col("sample_id") * 7 + F.col("feature_pos")) % 13
    sq_err = (
        F.when(marker == 0, F.lit(0.0))
        .when(marker == 1, F.lit(-1.0))
        .when(marker == 2, F.lit(None))
        .otherwise(F.col("value") * F.col("value"))
    )
    return matrix(spark, sf_dir).withColumn("sq_err", sq_err).drop("value", "label")


def clean_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with NULL as the only marker."""
    return errors(spark, sf_dir).withColumn("sq_err", F.when(F.col("sq_err") > 0, F.col("sq_err")))


def two_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of returned lines as cases and of all others as controls, one feature per supplier."""
    cohort = F.when(F.col("l_returnflag") == "A", "cases").otherwise("controls")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("feature_pos"), cohort.alias("cohort"), F.col("l_extendedprice").alias("score")
    )


def wide_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta matrix of many features: one sample per line number, return flag and line status, one feature per order number."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.when(F.col("l_returnflag") == "A", "cases").otherwise("controls").alias("cohort"),
        F.concat(F.lit("ds_"), "l_linestatus").alias("dataset"),
        F.col("l_linenumber").alias("sample_id"),
        (F.col("l_orderkey") % 25_000).cast("int").alias("feature_pos"),
    ).agg((F.min("l_extendedprice") / 100_000).alias("beta"))


def part_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A p-value per part, keyed by the bare part number."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("feature"),
        ((F.col("p_partkey") * 7919 % 1009 + 1) / F.lit(1010.0)).alias("p_ks"),
    )


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest: CpG, gene list of the part's suppliers, zero-padded key columns, own order.

    A supplier stands for GENES genes, one for each group of parts, so that a selection does not hit them all.
    """
    gene = F.concat(F.lit("s"), F.col("l_suppkey"), F.lit("_"), F.col("l_partkey") % GENES)
    genes = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set(gene)), ";").alias("gene_names"))
    part = table(spark, sf_dir, "part")
    return part.join(genes, part["p_partkey"] == genes["l_partkey"], "left").select(
        F.concat(F.when(F.col("p_type") == "SMALL", "ch").otherwise("cg"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("CpG"),
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("probe"),
        F.col("p_size").cast("string").alias("size_key"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("p_size") % 10 == 0, F.lit(".")).otherwise(F.col("gene_names")).alias("gene_names"),
        F.col("p_partkey").alias("cpg_order"),
    )


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' genes by nation; gene names differ in case from the annotation's."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    parts = supplier.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(GENES - 1))))
    gene = F.concat(F.lit("S"), F.col("s_suppkey"), F.lit("_"), F.col("part"))
    return nation.join(parts, nation["n_nationkey"] == parts["s_nationkey"]).select(
        F.col("n_name").alias("term"), gene.alias("gene"), F.col("n_nationkey").cast("bigint").alias("term_order")
    )


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, model, fold, auc) by part size, type and number."""
    return table(spark, sf_dir, "part").select(
        F.col("p_size").alias("k"),
        F.col("p_type").alias("model"),
        (F.col("p_partkey") % 5 + 1).cast("int").alias("fold"),
        (F.col("p_retailprice") % 100 / 100).alias("auc"),
    )

