"""Benchmark decontamination: SimHash of item-sized windows, Hamming multi-index, exact similarity.

A document is compared with an item of m words through its windows of m words. Windows that share no shingle with
any item have similarity zero, so only the stretches around shared shingles are looked at; every window there gets
a SimHash of its shingles. The items' fingerprints are indexed in blocks of eight bits: fingerprints within the
radius differ in at most radius // 8 bits in some block, so looking up each block finds all of them. Candidates
within the radius are verified by the exact similarity of the bags of shingles, sum of minima over sum of maxima.

``benchmark`` is a set of queries; it goes to the executors in parts of bounded size, one pass for each part.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from probestats.llm.shared import parts

BLOCKS = 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_ONES = np.array([[(b >> i) & 1 for i in range(8)] for b in range(256)], np.int8)
_BYTE_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def plain(word: str) -> str:
    """A word without case, width and punctuation; empty if nothing is left."""
    return "".join(c for c in unicodedata.normalize("NFKC", word).casefold() if c.isalnum())


def plain_words(text: str | None) -> list[str]:
    return [p for w in (text or "").split() if (p := plain(w))]


def hash_words(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def hash_shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words in a row; a shorter text is one shingle, no words none."""
    size = min(size, len(hashes))
    if not size:
        return hashes
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _FACTOR + (hashes[i : i + n] ^ (hashes[i : i + n] >> np.uint64(29)))
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def similarity(a: list, b: list) -> float:
    """Sum of minima over sum of maxima of two bags of shingles."""
    shared = (Counter(a) & Counter(b)).total()
    return shared / (len(a) + len(b) - shared) if a or b else 0.0


class Items:
    """The items of one part of the benchmark, by size in words, with their multi-index."""

    def __init__(self, rows: list[tuple[int, str | None]], size: int, radius: int, threshold: float):
        self.size, self.radius, self.threshold = size, radius, threshold
        self.by_words: dict[int, list[tuple[int, np.ndarray]]] = {}
        of_hash: dict[int, set[int]] = {}
        for item, text in rows:
            words = hash_words(plain_words(text))
            if not len(words):
                continue
            found = hash_shingles(words, size)
            self.by_words.setdefault(len(words), []).append((item, found))
            for h in found.tolist():
                of_hash.setdefault(h, set()).add(len(words))
        self.hashes = np.array(sorted(of_hash), np.uint64)
        self.words_at = [sorted(of_hash[h]) for h in self.hashes.tolist()]
        # a first look at 20 bits of a shingle's hash
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True
        self.short = sorted({m for m in self.by_words if m < size})
        self.prints = {m: fingerprints(np.concatenate([s for _, s in items]), np.cumsum([len(s) for _, s in items])) for m, items in self.by_words.items()}
        self.index = {m: self._blocks(p) for m, p in self.prints.items()}

    def _blocks(self, prints: np.ndarray) -> np.ndarray:
        """For each block and byte, whether each item's byte there is near enough."""
        return np.stack([_BYTE_DISTANCE[:, b] <= self.radius // BLOCKS for b in prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS).T])

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Positions of the shingles that some item has."""
        at = np.flatnonzero(self.maybe[shingles >> np.uint64(44)])
        where = np.searchsorted(self.hashes, shingles[at])
        return at[self.hashes[np.minimum(where, len(self.hashes) - 1)] == shingles[at]] if len(self.hashes) else at[:0]

    def near(self, m: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, found through the blocks."""
        found = []
        step = max(1, 4_000_000 // len(self.prints[m]))
        for start in range(0, len(prints), step):
            some = prints[start : start + step]
            bytes_ = some.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
            candidate = np.zeros((len(some), len(self.prints[m])), bool)
            for block in range(BLOCKS):
                candidate |= self.index[m][block][bytes_[:, block]]
            w, i = np.nonzero(candidate)
            within = np.bitwise_count(some[w] ^ self.prints[m][i]) <= self.radius
            found.append((w[within] + start, i[within]))
        return np.concatenate([w for w, _ in found]), np.concatenate([i for _, i in found])


def fingerprints(shingles: np.ndarray, ends: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """SimHash of the stretches [start, end) of shingles: bit i is set in over half of the hashes."""
    starts = np.r_[0, ends[:-1]] if starts is None else starts
    ones = _ONES[shingles.astype("<u8").view(np.uint8).reshape(-1, 8)].reshape(-1, 64)
    upto = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(ones, axis=0, out=upto[1:])
    over = 2 * (upto[ends] - upto[starts]) > (ends - starts)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _stretches(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Unions of overlapping or touching ranges [start, stop), given in the order of their starts."""
    out: list[tuple[int, int]] = []
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def match(hashes: np.ndarray, items: Items) -> dict[int, tuple[float, int, int, int]]:
    """item -> (similarity, first word, words, differing bits) of the best window of a text given as word hashes."""
    size = min(items.size, len(hashes))
    shingles = hash_shingles(hashes, items.size)
    best: dict[int, tuple[float, int, int, int]] = {}
    todo: dict[int, list[tuple[int, int]]] = {}
    hits = items.hits(shingles)
    where = np.searchsorted(items.hashes, shingles[hits])
    if len(hits):
        sizes = sorted({m for w in np.unique(where).tolist() for m in items.words_at[w]})
        for m in sizes:
            has = np.array([m in items.words_at[w] for w in where.tolist()])
            wide = max(0, m - size)  # windows that hold the shingle at i start from i - wide to i
            last = max(0, len(hashes) - m)
            at = hits[has]
            todo[m] = _stretches(np.clip(at - wide, 0, last), np.minimum(at, last) + 1)
    for m in items.short:  # items shorter than a shingle: their one shingle is shorter, too
        todo.pop(m, None)
        if len(hashes) >= m:
            whole = hash_shingles(hashes, m)
            for k, (item, own) in enumerate(items.by_words[m]):
                found = np.flatnonzero(whole == own[0])
                if len(found):
                    best[item] = (1.0, int(found[0]), m, 0)
    for m, stretches in todo.items():
        wide = max(1, m - size + 1)
        for first, stop in stretches:
            starts = np.arange(first, stop)
            ends = np.minimum(starts + wide, len(shingles))
            local = shingles[first : int(ends[-1])]
            prints = fingerprints(local, ends - first, starts - first)
            for w, i in zip(*(x.tolist() for x in items.near(m, prints)), strict=True):
                item, own = items.by_words[m][i]
                s = similarity(local[w : int(ends[w]) - first].tolist(), own.tolist())
                if s >= items.threshold and s > best.get(item, (0.0,))[0]:
                    best[item] = (s, first + w, m, int(np.bitwise_count(prints[w] ^ items.prints[m][i])))
    return best


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, radius: int = 24, part_bytes: int = 16_000_000
) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, similarity, first_word, n_words, bits.

    The row tells the first of the item's best windows, in words that have a letter or digit, compared without
    case and punctuation. The radius is wide: at similarity 0.8 fingerprints differ in 10 bits on average, and
    in more than 24 of 64 about once in a million. Runs a job to size the benchmark.

    NULL and blank texts match nothing; documents shorter than an item are compared as a whole. Rows that repeat a
    doc_id each return; rows that repeat an item_id count as one item, at its best match. NULL ids stay NULL.
    Other columns are ignored; an empty table on either side gives no rows.
    """
    found = None
    for rows in _item_parts(benchmark, part_bytes):
        one = _pass(docs, rows, size, radius, threshold)
        found = one if found is None else found.union(one)
    return found


def _item_parts(benchmark: DataFrame, part_bytes: int) -> Iterator[list[tuple]]:
    """The items in parts of about ``part_bytes`` of text: at least one part, if an empty one."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = total // part_bytes + 1
    for part in range(n_parts):
        yield [tuple(r) for r in items.where(F.coalesce(F.pmod(F.xxhash64("item_id"), F.lit(n_parts)), F.lit(0)) == part).collect()]


def _matches(batch: pa.RecordBatch, items: Items) -> Iterator[tuple[int, dict]]:
    """(row of the batch, what ``match`` finds) for rows that may hold an item."""
    split = pc.utf8_split_whitespace(batch.column("text").fill_null("").cast(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    words = [plain(w) for w in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    kept = np.array([bool(w) for w in words], bool)[codes]
    hashes = hash_words(words)[codes[kept]]
    ends = np.r_[0, np.cumsum(kept)][np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]
    starts = np.r_[0, ends[:-1]]
    if items.short:  # an item of fewer words than a shingle can be anywhere
        looked = range(len(ends))
    else:  # one look at all shingles of the batch tells which texts to look into
        looked = np.unique(np.searchsorted(ends, items.hits(hash_shingles(hashes, items.size)), side="right")).tolist()
    for i in looked:
        found = match(hashes[starts[i] : ends[i]], items)
        if found:
            yield i, found


def _pass(docs: DataFrame, rows: list[tuple], size: int, radius: int, threshold: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value, size, radius, threshold)
        for batch in parts(found, "text"):
            ids = batch.column("doc_id").to_pylist()
            out = [(ids[i], item, *row) for i, best in _matches(batch, items) for item, row in best.items()]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "first_word", "n_words", "bits"])

    rows_in = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows_in.mapInArrow(batches, "doc_id long, item_id long, similarity double, first_word long, n_words long, bits long")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, radius: int = 24, part_bytes: int = 16_000_000) -> DataFrame:
    """The documents that hold no benchmark item, row by row, with all columns as they are."""
    for rows in _item_parts(benchmark, part_bytes):
        docs = _without(docs, rows, size, radius, threshold)
    return docs


def _without(docs: DataFrame, rows: list[tuple], size: int, radius: int, threshold: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value, size, radius, threshold)
        for batch in parts(found, "text"):
            kept = np.ones(batch.num_rows, bool)
            kept[[i for i, _ in _matches(batch, items)]] = False
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(batches, docs.schema)
