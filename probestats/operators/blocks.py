"""Long rows to arrays: values scattered to their places, in Arrow."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Places of the arrays that are filled together.
FILLED_AT_ONCE = 2_000_000


def arrays_by_position(rows: DataFrame, keys: Sequence[str], position: Column, value: Column, width: int) -> DataFrame:
    """Per key one array of ``width`` doubles, each value at its position (from 0); NULL where there is none.

    Rows come sorted by key and position and are written into a preallocated array, so a value costs the same whatever
    the width, and a task holds one key's rows and a bounded number of arrays. Positions outside of the width are left
    out; a position given twice raises.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    given = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    placed = rows.select(*given, position.cast("int").alias("_pos"), value.cast("double").alias("_v")).where(F.col("_pos").between(0, width - 1))
    dealt = placed.repartition(*names).sortWithinPartitions(*names, "_pos")

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run: pa.RecordBatch | None = None  # rows of the last key so far, fewer than ``width``
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch if open_run is None else pa.concat_batches([open_run, batch])
            starts = _starts(found, names)
            yield from _filled(found.slice(0, starts[-1]), starts[:-1], names, width)
            open_run = found.slice(starts[-1])
        if open_run is not None:
            yield from _filled(open_run, np.zeros(1, np.int64), names, width)

    schema = ", ".join(f"{n} {rows.schema[k].dataType.simpleString()}" for k, n in zip(keys, names, strict=True))
    out = dealt.mapInArrow(scatter, f"{schema}, values array<double>")
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "values")


def _starts(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Where a new key starts; NULL equals NULL."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in names:
        before, after = batch.column(name).slice(0, batch.num_rows - 1), batch.column(name).slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(before, after), False), pc.xor(pc.is_null(before), pc.is_null(after)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _filled(batch: pa.RecordBatch, starts: np.ndarray, names: Sequence[str], width: int) -> Iterator[pa.RecordBatch]:
    if not len(starts):
        return
    position, values = batch.column("_pos").to_numpy(), batch.column("_v")
    numbers, there = values.to_numpy(zero_copy_only=False), pc.is_valid(values).to_numpy(zero_copy_only=False)
    ends = np.r_[starts[1:], batch.num_rows]
    first = np.zeros(batch.num_rows, bool)
    first[starts] = True
    if (~first[1:] & (position[1:] == position[:-1])).any():
        raise ValueError("a position is given twice")
    together = max(1, FILLED_AT_ONCE // width)
    for a in range(0, len(starts), together):
        some = slice(starts[a], ends[min(a + together, len(starts)) - 1])
        sizes = (ends - starts)[a : a + together]
        at = np.repeat(np.arange(len(sizes)) * width, sizes) + position[some]
        out, missing = np.zeros(len(sizes) * width), np.ones(len(sizes) * width, bool)
        out[at] = np.where(there[some], numbers[some], 0.0)
        missing[at] = ~there[some]
        arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * np.int32(width)), pa.array(out, mask=missing))
        keys = [batch.column(n).take(pa.array(starts[a : a + together])) for n in names]
        yield pa.RecordBatch.from_arrays([*keys, arrays], [*names, "values"])
