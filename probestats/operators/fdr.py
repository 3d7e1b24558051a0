"""Benjamini-Hochberg q-values without a window over all tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from probestats.operators.ordered import CELL, Cells, join_lookup, null_safe_join, running_totals


def bh_fdr(
    tests: DataFrame,
    p: str = "p_ks",
    *,
    by: Sequence[str] = (),
    name: str = "fdr_bh",
    hot_rows: int | None = None,
) -> DataFrame:
    """Add the q-value of each test; a NULL p counts as 1.

    Tests with equal p have one q, so the work is done on distinct p: the rank is a running total, the
    running minimum from the largest p down is taken inside each cell and joined with the minimum of all
    later cells. Then each test looks up the q of its p.
    """
    keys = list(by)
    filled = tests.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0)))
    totals, cells = running_totals(filled.select(*keys, "_p"), keys, "_p", {"n": F.lit(1)}, hot_rows=hot_rows)
    levels = totals.select(*keys, CELL, "_p", "n", (F.col("_p") * F.col("n_total") / F.col("n_cum")).alias("_raw"))
    if cells is None:  # one cell a key
        down = W.partitionBy(*keys).orderBy(F.col("_p").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
        least = levels.withColumn("_q", F.min("_raw").over(down))
    else:
        down = W.partitionBy(*keys, CELL).orderBy(F.col("_p").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
        tails = _later_minimum(levels, keys, cells)
        least = null_safe_join(levels, tails, [*keys, CELL]).withColumn("_q", F.least(F.min("_raw").over(down), F.col("_tail")))
    q = F.greatest(F.least(F.col("_q"), F.lit(1.0)), F.lit(0.0))
    lookup = least.select(*keys, "_p", F.col("n").alias("_n"), q.alias(name))
    return join_lookup(filled, lookup, [*keys, "_p"], size="_n", hot_rows=hot_rows).drop("_p")


def _later_minimum(levels: DataFrame, keys: Sequence[str], cells: Cells) -> DataFrame:
    """Per cell the least ``_raw`` of all later cells: over the ranges of the first cut, then inside each."""
    least = levels.groupBy(*keys, CELL).agg(F.min("_raw").alias("_least")).withColumn("_top", cells.top())
    after = W.partitionBy(*keys, "_top").orderBy(F.col(CELL).desc()).rowsBetween(W.unboundedPreceding, -1)
    own = least.withColumn("_inside", F.min("_least").over(after))
    later = W.partitionBy(*keys).orderBy(F.col("_top").desc()).rowsBetween(W.unboundedPreceding, -1)
    coarse = least.groupBy(*keys, "_top").agg(F.min("_least").alias("_of_top")).withColumn("_beyond", F.min("_of_top").over(later)).drop("_of_top")
    return null_safe_join(own, coarse, [*keys, "_top"]).select(*keys, CELL, F.least("_inside", "_beyond").alias("_tail"))


def ks_table(stats: DataFrame, *, keys: Sequence[str] = ("feature_pos",)) -> DataFrame:
    """Tests with their q-values, smallest p first, NULL p last, ties by key."""
    return bh_fdr(stats, "p_ks").orderBy(F.col("p_ks").asc_nulls_last(), *keys)


def top_tests(stats: DataFrame, n: int, *, p: str = "p_ks", keys: Sequence[str] = ("feature_pos",)) -> DataFrame:
    return stats.orderBy(F.col(p).asc_nulls_last(), *keys).limit(n)
