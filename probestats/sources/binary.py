"""Binary matrices (.npy) as a Spark data source, read as the long matrix.

``spark.read.format("npy_matrix")`` lists the files and reads their headers, plans one partition for every few megabytes of
*wanted* stored rows, and each task reads only the bytes of its rows. Filters on cohort, dataset, sample and feature are
taken over by the source: they choose files, stored rows and places within a row before anything is read.

Options: ``path`` (files below it), ``cohort``, ``value`` (name of the value column, default ``sq_err``), ``orientation``
(``samples_first`` or ``features_first``), ``missing`` (markers that become NULL like NaN, comma list, default -1),
``columns`` (comma list of the columns wanted; without the value no data is read) and ``chunkBytes``.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

CHUNK_BYTES = 32 << 20
#: Values in one Arrow batch.
BATCH_VALUES = 1 << 18
ENDING = ".npy"
KEYS = {"cohort": "string", "dataset": "string", "sample_id": "string", "feature_pos": "int"}


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _find(root: str) -> list[str]:
    """Paths of all matrices below ``root``, in order."""
    from pyarrow import fs

    system, inner = _filesystem(root)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [inner]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(x.path for x in found if x.type == fs.FileType.File and x.path.endswith(ENDING))


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(ENDING)


@dataclass(frozen=True)
class Layout:
    """Where the numbers of a file are: ``rows`` stored rows of ``cols`` numbers each, from byte ``start`` on."""

    dtype: str
    rows: int
    cols: int
    turned: bool  # stored by columns: its stored rows are the matrix columns
    start: int

    @property
    def row_bytes(self) -> int:
        return self.cols * np.dtype(self.dtype).itemsize


def read_layout(file, path: str) -> Layout:
    """From the header alone, whatever its length and version."""
    magic = file.read(8)
    if magic[:6] != b"\x93NUMPY" or len(magic) < 8:
        raise ValueError(f"{path} is not a matrix file")
    version = magic[6]
    if version not in (1, 2, 3):
        raise ValueError(f"{path} has header version {version}")
    size = struct.unpack("<H", file.read(2))[0] if version == 1 else struct.unpack("<I", file.read(4))[0]
    head = ast.literal_eval(file.read(size).decode("utf-8" if version == 3 else "latin-1"))
    dtype, shape = np.lib.format.descr_to_dtype(head["descr"]), head["shape"]
    if len(shape) != 2:
        raise ValueError(f"{path} is not a 2-D matrix (shape {shape})")
    if dtype.kind not in "fiub":
        raise ValueError(f"{path} holds no numbers ({dtype})")
    rows, cols = shape[::-1] if head["fortran_order"] else shape
    return Layout(dtype.str, rows, cols, head["fortran_order"], 8 + (2 if version == 1 else 4) + size)


class Places:
    """Wanted positions of one axis: a range, and a list if only some of it are wanted."""

    def __init__(self):
        self.low, self.high, self.only = 0, None, None

    def at_least(self, n: float) -> None:
        self.low = max(self.low, int(np.ceil(n)))

    def below(self, n: float) -> None:
        self.high = int(np.ceil(n)) if self.high is None else min(self.high, int(np.ceil(n)))

    def among(self, found: set[int]) -> None:
        self.only = found if self.only is None else self.only & found

    def of(self, size: int) -> np.ndarray | slice:
        """Those below ``size``, in order: a slice if they are all of a range."""
        low, high = max(self.low, 0), size if self.high is None else max(min(self.high, size), 0)
        if self.only is None:
            return slice(low, max(low, high))
        return np.array(sorted(x for x in self.only if low <= x < high), np.int64)


def _count(places: np.ndarray | slice) -> int:
    return places.stop - places.start if isinstance(places, slice) else len(places)


@dataclass
class Rows(InputPartition):
    """Some stored rows of one file, and the wanted places in each."""

    path: str
    layout: Layout
    rows: np.ndarray | slice
    cols: np.ndarray | slice


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.root, self.cohort = options["path"], options.get("cohort", "")
        self.samples_first = options.get("orientation", "samples_first") == "samples_first"
        self.missing = [float(x) for x in options.get("missing", "-1").split(",") if x.strip()]
        self.chunk = int(options.get("chunkbytes", CHUNK_BYTES))
        self.value, self.columns = options.get("value", "sq_err"), columns
        self.datasets: set[str] | None = None
        self.cohort_wanted = True
        self.axis = {"sample_id": Places(), "feature_pos": Places()}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what the keys alone decide; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in KEYS or not self._take(column, f):
                yield f

    def _take(self, column: str, f: Filter) -> bool:
        values = list(f.value) if isinstance(f, In) else [f.value] if isinstance(f, EqualTo) else None
        if isinstance(f, IsNotNull):
            return True  # no key is NULL
        if values is not None:
            values = [v for v in values if v is not None]
        if column == "cohort" and values is not None:
            self.cohort_wanted &= self.cohort in values
        elif column == "dataset" and values is not None:
            self.datasets = set(values) if self.datasets is None else self.datasets & set(values)
        elif column == "sample_id" and values is not None:  # numbers as text
            self.axis[column].among({int(v) for v in values if v.isascii() and v.isdigit() and str(int(v)) == v})
        elif column == "feature_pos" and values is not None:
            self.axis[column].among(set(values))
        elif column == "feature_pos" and isinstance(f, GreaterThanOrEqual | GreaterThan):
            self.axis[column].at_least(f.value + isinstance(f, GreaterThan))
        elif column == "feature_pos" and isinstance(f, LessThan | LessThanOrEqual):
            self.axis[column].below(f.value + isinstance(f, LessThanOrEqual))
        else:
            return False
        return True

    def _open(self, path: str):
        return _filesystem(self.root)[0].open_input_file(path)

    def _layout(self, path: str) -> Layout:
        with self._open(path) as file:
            return read_layout(file, path)

    def partitions(self) -> list[InputPartition]:
        paths = [p for p in _find(self.root) if self.datasets is None or stem(p) in self.datasets] if self.cohort_wanted else []
        with ThreadPoolExecutor(16) as pool:
            layouts = list(pool.map(self._layout, paths))
        out: list[InputPartition] = []
        for path, layout in zip(paths, layouts, strict=True):
            samples, features = (self.axis[c].of(n) for c, n in zip(("sample_id", "feature_pos"), self._shape(layout), strict=True))
            rows, cols = (samples, features) if self._rows_are_samples(layout) else (features, samples)
            n_rows, n_cols = _count(rows), _count(cols)
            if not n_cols:
                continue
            step = max(1, self.chunk // max(1, n_cols * np.dtype(layout.dtype).itemsize))
            for first in range(0, n_rows, step):
                last = min(first + step, n_rows)
                part = slice(rows.start + first, rows.start + last) if isinstance(rows, slice) else rows[first:last]
                out.append(Rows(path, layout, part, cols))
        return out or [Rows("", Layout("<f8", 0, 0, False, 0), slice(0, 0), slice(0, 0))]

    def _rows_are_samples(self, layout: Layout) -> bool:
        return layout.turned != self.samples_first

    def _shape(self, layout: Layout) -> tuple[int, int]:
        """Numbers of samples and of features."""
        return (layout.rows, layout.cols) if self._rows_are_samples(layout) else (layout.cols, layout.rows)

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not _count(partition.rows):
            return
        layout, rows, cols = partition.layout, partition.rows, partition.cols
        numbers = np.arange(rows.start, rows.stop) if isinstance(rows, slice) else rows
        places = np.arange(cols.start, cols.stop) if isinstance(cols, slice) else cols
        step = max(1, BATCH_VALUES // len(places))
        if self.value not in self.columns:
            for first in range(0, len(numbers), step):
                yield from self._batches(partition, numbers[first : first + step], places, None)
            return
        with self._open(partition.path) as file:
            for first in range(0, len(numbers), step):
                some = numbers[first : first + step]
                yield from self._batches(partition, some, places, self._values(file, layout, some, places))

    @staticmethod
    def _values(file, layout: Layout, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The wanted numbers: rows next to each other in one read, of each the bytes from the first to the last wanted place."""
        dtype = np.dtype(layout.dtype)
        low, high = int(places[0]), int(places[-1]) + 1
        out = np.empty((len(rows), len(places)))
        edges = np.r_[0, np.flatnonzero(np.diff(rows) != 1) + 1, len(rows)]
        whole = 2 * (high - low) >= layout.cols  # most of each row: not row by row
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if whole:
                start = layout.start + int(rows[a]) * layout.row_bytes
                raw = file.read_at(int(b - a) * layout.row_bytes, start)
                out[a:b] = np.frombuffer(raw, dtype).reshape(b - a, layout.cols)[:, places]
                continue
            for r in range(a, b):
                start = layout.start + int(rows[r]) * layout.row_bytes + low * dtype.itemsize
                out[r] = np.frombuffer(file.read_at((high - low) * dtype.itemsize, start), dtype)[places - low]
        return out

    def _batches(self, partition: Rows, rows: np.ndarray, places: np.ndarray, values: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_VALUES // len(rows))
        for first in range(0, len(places), step):
            some = places[first : first + step]
            row, place = np.repeat(rows, len(some)), np.tile(some, len(rows))
            sample, feature = (row, place) if self._rows_are_samples(partition.layout) else (place, row)
            made = []
            for c in self.columns:
                if c == "cohort":
                    made.append(pa.repeat(pa.scalar(self.cohort, pa.string()), len(row)))
                elif c == "dataset":
                    made.append(pa.repeat(pa.scalar(stem(partition.path), pa.string()), len(row)))
                elif c == "sample_id":
                    made.append(pa.array(sample).cast(pa.string()))
                elif c == "feature_pos":
                    made.append(pa.array(feature.astype(np.int32)))
                else:
                    v = values[:, first : first + step].ravel()
                    made.append(pa.array(v, pa.float64(), mask=np.isnan(v) | np.isin(v, self.missing)))
            yield pa.RecordBatch.from_arrays(made, self.columns)


class NpyMatrix(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def _columns(self) -> list[str]:
        every = [*KEYS, self.options.get("value", "sq_err")]
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or every
        if unknown := set(wanted) - set(every):
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        return [c for c in every if c in wanted]

    def schema(self) -> str:
        return ", ".join(f"{c} {KEYS.get(c, 'double')}" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(dict(self.options), self._columns())


def list_matrices(spark: SparkSession, root: str) -> DataFrame:
    """(path, stem) of all matrices below ``root``."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=f"*{ENDING}").load(root).select("path")
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("stem"))


def read_matrices(
    spark: SparkSession,
    root: str,
    *,
    cohort: str,
    orientation: str = "samples_first",
    value: str = "sq_err",
    missing: tuple[float, ...] = (-1.0,),
    columns: tuple[str, ...] = (),
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """All matrices below ``root`` as cohort, dataset, sample_id, feature_pos, value.

    NaN and the ``missing`` markers become NULL; the dataset is the file's stem, and the place of a sample within its file
    serves as its id. ``where`` on the keys and ``columns`` limit what is read.
    """
    if orientation not in ("samples_first", "features_first"):
        raise ValueError(f"unknown orientation: {orientation}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpyMatrix)
    options = {"path": root, "cohort": cohort, "orientation": orientation, "value": value, "chunkBytes": chunk_bytes}
    options |= {"missing": ",".join(map(repr, missing)), "columns": ",".join(columns)}
    return spark.read.format("npy_matrix").options(**options).load()
