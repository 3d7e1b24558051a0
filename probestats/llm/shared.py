"""What several corpus operators need: words, text batches, and the checked broadcast."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes up to which rows go to Python in one Arrow batch. Spark takes 64 MB, or 10,000 rows; the executor's writer and
#: the worker each hold such a batch, and parts of it a second time.
BATCH_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str) -> list[bytes]:
    """The runs of ``[^\\x20\\x09-\\x0D]`` of a text, as UTF-8; splitting bytes leaves other spaces inside words."""
    return text.encode().split()


@cache
def _trim():
    """The C library's call that gives freed memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def give_back() -> None:
    """Returns freed memory to the system: it would stay with the Python worker, which serves other tasks, too."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python end at ``BATCH_BYTES``; a row is never cut."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def parts(batches: Iterator[pa.RecordBatch], text: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices with about ``chars`` bytes of text, so that memory follows the text, not the rows.

    A row is never cut: one text of any length is one slice at least. What a worker's earlier tasks have freed goes back
    to the system before the first slice.
    """
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        start = size = 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()):
            if size and size + n > chars:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)
        give_back()


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """CRC-32 of the id as text (NULL for a NULL id)."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted by a job); otherwise as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_ids(rows: DataFrame, by: str, most: int) -> DataFrame:
    """``by``, doc_id: the first ``most`` distinct ids of each value of ``by`` in hash order, all where there are fewer.

    However often an id is repeated, it counts once. Ids are counted in 4,096 ranges of their hash first, so that only
    those of the ranges that hold the first ``most`` come to be ordered.
    """
    hash_ = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    ids = rows.select(by, "doc_id").distinct().withColumn("_hash", hash_).withColumn("_range", F.shiftright("_hash", 28))
    counts = ids.groupBy(F.col(by).alias("_of"), "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_of").orderBy("_range")) - F.col("_n")
    last = counts.withColumn("_before", before).where(F.col("_before") < most).groupBy("_of").agg(F.max("_range").alias("_last"))
    few = ids.join(small(last), F.col(by) == F.col("_of")).where(F.col("_range") <= F.col("_last"))
    order = Window.partitionBy(by).orderBy("_hash", "doc_id")
    return few.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most).select(by, "doc_id")
