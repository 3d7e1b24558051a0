"""Arrays by position, against a plain scatter, at any width."""

import random

import pytest
from pyspark.sql import functions as F

from probestats.operators import blocks, errors


@pytest.mark.parametrize("width", [1, 7, 400])
def test_values_are_scattered(spark, width, monkeypatch):
    monkeypatch.setattr(blocks, "FILLED_AT_ONCE", 900)
    rng, rows, want = random.Random(width), [], {}
    for k in [None, "a", "b", "c", *map(str, range(60))]:
        for j in (None, 1, 2):
            places = rng.sample(range(width + 2), rng.randint(0, width))
            for p in places:
                v = rng.choice([None, float(p), float("nan"), -0.5])
                rows.append((k, j, p, v))
                if p < width:
                    want.setdefault((k, j), [None] * width)[p] = v
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, j int, p long, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = blocks.arrays_by_position(df, ["k", "j"], F.col("p"), F.col("v"), width).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want)
    assert {(r["k"], r["j"]): str(r["values"]) for r in got} == {k: str(v) for k, v in want.items()}


def test_a_position_given_twice_raises(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.5)], "k string, p int, v double")
    with pytest.raises(Exception, match="given twice"):
        blocks.arrays_by_position(df, ["k"], F.col("p"), F.col("v"), 3).collect()
    assert blocks.arrays_by_position(df.limit(0), ["k"], F.col("p"), F.col("v"), 3).count() == 0


def test_wide_segments_cost_as_much_per_value_as_narrow_ones(spark):
    """100 samples by 10,000 features, in segments of 1,000 and of 10,000."""
    import time

    betas = spark.range(0, 1_000_000, 1, 8).select(
        F.lit("c").alias("cohort"), F.lit("d").alias("dataset"), (F.col("id") % 100).alias("sample_id"), F.expr("id div 100").cast("int").alias("feature_pos"), F.rand(1).alias("beta")
    )
    seconds = {}
    for width in (1_000, 10_000, 1_000, 10_000):
        start = time.perf_counter()
        found = errors.to_blocks(betas, width=width).agg(F.count("*"), F.sum(F.size("values"))).first()
        seconds[width] = time.perf_counter() - start
        assert tuple(found) == (1_000_000 // width, 1_000_000)
    assert seconds[10_000] < 2 * seconds[1_000]
