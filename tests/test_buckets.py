"""Matrices in buckets of features meet where they lie."""

import pytest
from pyspark.sql import functions as F

from probestats.operators import errors, score
from probestats.sources import sinks


@pytest.fixture()
def matrices(spark, tmp_path):
    """Errors and predictions of 40 samples by 500 features, in 8 buckets; no joins by broadcast."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, "cases").otherwise("controls").alias("cohort"), F.lit("d").alias("dataset"), (F.col("id") % 40).alias("sample_id"),
        F.expr("id div 40").cast("int").alias("feature_pos"), (F.xxhash64("id") % 1000 / 1000).alias("beta"),
    )
    tables = {}
    for name, column in (("betas", F.col("beta")), ("predictions", F.col("beta") * 0.9)):
        kept = rows.withColumn("beta", column).withColumnRenamed("beta", "beta" if name == "betas" else "prediction")
        tables[name] = sinks.write_bucketed(kept, f"bucketed_{name}", buckets=8, path=str(tmp_path / name))
    yield rows, tables, tmp_path
    for name in tables:
        spark.sql(f"DROP TABLE bucketed_{name}")
    for c, v in old.items():
        spark.conf.set(c, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_need_no_exchange(spark, matrices):
    rows, tables, path = matrices
    errs = tables["betas"].withColumnRenamed("beta", "sq_err")
    out = score.rec_score(errs, score.control_baseline(errs.where("cohort = 'controls'")))
    assert "Exchange" not in plan(out) and "SortMergeJoin" in plan(out)
    plain = rows.withColumnRenamed("beta", "sq_err")
    want = score.rec_score(plain, score.control_baseline(plain.where("cohort = 'controls'")))
    assert "Exchange" in plan(want)
    assert sorted(map(tuple, out.select("sample_id", "feature_pos", F.round("score", 9)).collect())) == sorted(map(tuple, want.select("sample_id", "feature_pos", F.round("score", 9)).collect()))
    files = list((path / "betas").glob("*.parquet"))
    assert len(files) == 8  # one for each bucket


def test_betas_and_predictions_need_no_exchange(spark, matrices):
    _, tables, _ = matrices
    out = errors.squared_error(tables["betas"], tables["predictions"])
    assert "Exchange" not in plan(out)
    assert out.count() == 20_000 and out.where("sq_err > 0.0100001").isEmpty()
    # moments by feature, too
    assert "Exchange" not in plan(out.groupBy("feature_pos").agg(F.avg("sq_err")))
