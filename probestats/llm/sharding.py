"""A reproducible shuffle into shards: a keyed Feistel permutation of global row numbers.

Row numbers follow (doc_id, checksum, size). The permutation is computed per row from the row number alone, so
shard and slot of a row, and the row at a shard and slot, are known without moving or sorting anything again.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from probestats.operators.stage import stage

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves about half of the output bits."""
    x = x.astype(np.uint64) + np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _sides(n: int) -> tuple[int, int]:
    """The smallest near-square grid that holds ``n`` cells."""
    a = isqrt(n - 1) + 1
    return a, -(-n // a)


def _round_key(seed: int, i: int) -> int:
    return ((seed * 0x9E3779B97F4A7C15) + (i + 1) * 0xD1B54A32D192ED03) % 2**64


def _once(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    a, b = _sides(n)
    left, right = x // b, x % b
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        key, sign = _round_key(seed, i), -1 if back else 1
        if i % 2:
            right = (right + sign * (_mix(left, key) % np.uint64(b)).astype(np.int64)) % b
        else:
            left = (left + sign * (_mix(right, key) % np.uint64(a)).astype(np.int64)) % a
    return left * b + right


def permute(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """A permutation of 0..n-1 (``back``: its inverse), at each of ``x``.

    The Feistel network permutes a grid of at least ``n`` cells; a number that lands at ``n`` or beyond goes
    through it again until it falls below ``n`` (cycle walking). As it permutes the grid, the walk always ends.
    """
    x = _once(np.asarray(x, np.int64), n, seed, back)
    while (out := x >= n).any():
        x[out] = _once(x[out], n, seed, back)
    return x


def place(row: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers."""
    p = permute(row, n, seed)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """The row number at a shard and slot."""
    return permute(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64), n, seed, back=True)


def number_rows(rows: DataFrame, order: list[str], cells: int | None = None) -> tuple[DataFrame, int]:
    """Add ``row`` (0, 1, ...) in the order of ``order``; equal rows are numbered either way. Also the number of rows. Runs jobs.

    Ranges of the order are counted first; a row's number is its place in its range plus the counts of the
    ranges before. Only the ``cells`` counts meet in one task.
    """
    cells = cells or max(8, rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # equal rows may lie in different ranges: which of them comes first does not show
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    ranged = stage(salted.repartitionByRange(cells, *order, "salt").withColumn("cell", F.spark_partition_id()).drop("salt"), "ranges")
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("cell").count().select("cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("cell").orderBy(*order))
    # at most `cells` rows are broadcast, a number fixed before any row is read
    return ranged.join(F.broadcast(starts), "cell").withColumn("row", F.col("start") + inside - 1).drop("cell", "start"), ranged.count()


def shard(docs: DataFrame, shards: int = 24, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: shards differ by one document at most, and slots are 0, 1, ... in each. Size is the text's
    UTF-8 bytes plus 8. Runs jobs.

    A NULL text counts as empty; a NULL doc_id sorts first; repeated rows each get a slot of their own (which
    of two equal rows gets which slot does not show); other columns are ignored; an empty table gives no rows.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    numbered, n = number_rows(rows, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def permuted(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    return numbered.withColumn("p", permuted("row")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("p") % shards).cast("int").alias("shard"),
        F.expr(f"p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 42, files_per_shard: int = 1) -> None:
    """Write the documents in shard order: ``shard=N`` folders whose files hold runs of slots, each sorted.

    Documents are matched with their places by (doc_id, checksum, size), with a running number among equals.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    key = ["doc_id", "text_crc32", "size"]
    same = Window.partitionBy(*key)
    places = shard(docs, shards, seed).withColumn("nth", F.row_number().over(same.orderBy("shard", "slot")))
    whole = docs.select("doc_id", "text", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    whole = whole.withColumn("nth", F.row_number().over(same.orderBy("size")))
    on = [whole[c].eqNullSafe(places[c]) for c in [*key, "nth"]]
    placed = whole.join(places, on).select(whole["doc_id"], "text", "shard", "slot")
    part = F.col("slot") % files_per_shard
    placed.repartition(shards * files_per_shard, "shard", part).sortWithinPartitions("shard", part, "slot").write.partitionBy("shard").parquet(path)
