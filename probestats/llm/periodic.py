"""Runs of repeated words in documents: maximal stretches that repeat a period four times or more.

A run of period q and length 4 q or more holds, for some multiple g of 3 q, both g and g + q. So these harmonic grids, n / 3q
places for each q, are all that has to be looked at; how far the words around such a pair agree is asked of a run-length
grammar (``recompression``), exactly, for the grids of many periods and documents at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from probestats.llm.recompression import Grammar
from probestats.llm.shared import parts

LEAST_LENGTH, LEAST_POWER = 6, 4
#: Texts that are looked at together, in bytes.
SLICE = 2_000_000


def runs(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, length, period) of every run of every sequence of symbols (whole numbers from 0).

    A run is a stretch whose smallest period is ``period``, at least ``LEAST_LENGTH`` and four periods long, which no
    neighbour extends. Ordered by sequence, start and period.
    """
    size = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-size, kind="stable")  # longest first: period q concerns a beginning of the whole
    order = order[size[order] >= LEAST_LENGTH]
    if not len(order):
        return (np.empty(0, np.int64),) * 4
    size = size[order]
    begin = np.cumsum(size + 1) - size  # a wall before each, and one behind the last
    walls = np.r_[begin - 1, begin[-1] + size[-1]]
    whole = np.empty(walls[-1] + 1, np.int64)
    for at, n, i in zip(begin, size, order, strict=True):
        whole[at : at + n] = sequences[i]
    symbols = int(max(sequences[i].max() for i in order)) + 1
    whole[walls] = symbols + np.arange(len(walls))
    grammar = Grammar(whole, walls)

    found: list[np.ndarray] = []  # rows of start, end, period
    known = np.full(len(whole), -1, np.int64)  # the last long run that holds a place
    known_rows = np.empty((0, 3), np.int64)
    least, top = 1, int(size[0]) // LEAST_POWER
    while least <= top:
        upto = min(2 * least - 1, top)  # no multiple of a period in the same octave
        i, q = _grid(whole, begin, size, least, upto)
        if len(i) and len(known_rows):
            row = known_rows[known[i]]
            i, q = (x[~((known[i] >= 0) & (i + q < row[:, 1]) & (q % row[:, 2] == 0))] for x in (i, q))
        if len(i):
            start = i - grammar.extend(i - 1, i + q - 1, -1)
            end = i + q + grammar.extend(i, i + q, 1)
            long = end - start >= np.maximum(LEAST_LENGTH, LEAST_POWER * q)
            new = np.unique(np.stack([start[long], end[long], q[long]], 1), axis=0)
            found.append(new)
            wide = new[new[:, 1] - new[:, 0] >= 2 * LEAST_POWER * new[:, 2]]
            for r, (s, e, _) in enumerate(wide.tolist(), len(known_rows)):
                known[s:e] = r
            known_rows = np.concatenate([known_rows, wide])
        least = upto + 1
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    # by the periodicity lemma a multiple of the smallest period extends to the same stretch
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)][: len(rows)]]
    which = np.searchsorted(begin, rows[:, 0], side="right") - 1
    sequence, start, length, period = order[which], rows[:, 0] - begin[which], rows[:, 1] - rows[:, 0], rows[:, 2]
    o = np.lexsort((period, start, sequence))
    return sequence[o], start[o], length[o], period[o]


def _grid(whole: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid places i and periods q of ``least`` to ``upto`` where the words at i and i + q are equal, and a neighbour's."""
    places, periods = [], []
    ends = begin + size
    n_long = np.searchsorted(-size, -LEAST_POWER * np.arange(least, upto + 1), side="right")
    for q, n in zip(range(least, upto + 1), n_long.tolist(), strict=True):
        part = whole[: ends[n - 1] + 1]
        i = np.arange(0, len(part) - q, 3 * q)
        i = i[part[i] == part[i + q]]
        if len(i):  # never the first or last place: those are walls
            i = i[(part[i + 1] == part[i + q + 1]) | (part[i - 1] == part[i + q - 1])]
            places.append(i)
            periods.append(np.full(len(i), q))
    return (np.concatenate(places), np.concatenate(periods)) if places else (np.empty(0, np.int64),) * 2


def damaged(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place where the rule repeats a tail of the document; None where it does not."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.r_[np.arange(a), a + np.arange(n - a) % p]


def _summary(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    if not len(start):
        return 0, None, None, None, None, hashlib.sha256().hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    rows = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    best = rows[0]
    drop = np.zeros(len(words), bool)
    for row in rows:  # by start, then period, so that only a greater exponent replaces
        s, n, q = row
        drop[s + q : s + n] = True
        if n * best[2] > best[1] * q:
            best = row
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
    kept = b" ".join([words[i] for i in np.flatnonzero(~drop)])
    return len(rows), *best, 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def _batches(found: Iterator[pa.RecordBatch], repeat_tails: bool, details: bool) -> Iterator[pa.RecordBatch]:
    for batch in parts(found, "text", SLICE):
        ids = batch.column("doc_id").to_pylist()
        texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
        coded = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum([0, *map(len, texts)])
        sequences = [coded[ends[k] : ends[k + 1]] for k in range(len(texts))]
        if repeat_tails:
            for k, doc_id in enumerate(ids):
                places = damaged(len(texts[k]), doc_id)
                if places is not None:
                    sequences[k] = sequences[k][places]
                    texts[k] = [texts[k][i] for i in places.tolist()]
        sequence, start, length, period = runs(sequences)
        if details:
            of = batch.column("doc_id").take(pa.array(sequence))
            yield pa.RecordBatch.from_arrays([of, *map(pa.array, (start, length, period))], ["doc_id", "start", "length", "period"])
            continue
        cut = np.searchsorted(sequence, np.arange(len(texts) + 1))
        rows = [_summary(t, *(x[cut[k] : cut[k + 1]] for x in (start, length, period))) for k, t in enumerate(texts)]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.string()] * 2, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *SUMMARY])


SUMMARY = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def find_runs(docs: DataFrame, repeat_tails: bool = False) -> DataFrame:
    """One row per run: doc_id, start (word number), length, period. Documents without runs have no row.

    Words are the runs of ``[^\\x20\\x09-\\x0D]``, whole texts are looked at. ``repeat_tails`` first repeats a tail of one
    document in ten, as its doc_id tells. NULL and empty texts have no run; repeated rows are looked at each; a NULL
    doc_id stays NULL (and its tail as it is). Other columns are ignored. Empty table: no rows.
    """
    return _documents(docs).mapInArrow(lambda found: _batches(found, repeat_tails, True), "doc_id long, start long, length long, period long")


def summarize(docs: DataFrame, repeat_tails: bool = False) -> DataFrame:
    """One row per document: its number of runs, the run of the greatest exponent, and digests.

    ``start``, ``length``, ``period`` and ``exponent_milli`` are of the run with the greatest length / period (ties: smallest
    start, then period), NULL without one. ``runs_sha256`` is over every run's ``start,length,period`` and a line end, by
    start, then period; ``collapsed_sha256`` over the words without those that a run holds after its first period.
    Nulls, repeats and other columns as in ``find_runs``; each document has its row.
    """
    kind = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _documents(docs).mapInArrow(lambda found: _batches(found, repeat_tails, False), kind)
