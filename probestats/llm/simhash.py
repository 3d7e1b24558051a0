"""SimHash near-duplicates: bit-sliced comparison inside the blocks of a multi-index.

Fingerprints within the radius agree on enough pieces of their bits to share a block (see ``block_keys``). Inside
a block they are stored as bit planes, one bit of 64 fingerprints to a machine word, and compared with their
neighbours at distance 1, 2, ... along the block: the planes' XORs are counted for all neighbours at once by a
carry-save counter, and words in which every distance already exceeds the radius are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from probestats.llm.components import components
from probestats.llm.shared import parts, small
from probestats.operators.stage import stage

BITS = 64
SEED = 42
#: Bytes of a hash to eight counters of eight bits in one word: bit i of the byte goes to counter i.
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def shingles(text: bytes, size: int) -> list[bytes]:
    """Word shingles of a text with A-Z lowered, repeats included; one shorter shingle if there are fewer words."""
    w = text.lower().split()
    if not w:
        return []
    return list(map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False))) if len(w) >= size else [b" ".join(w)]


def fingerprint(found: list[bytes]) -> int:
    """Bit i is set if more than half of the shingles' hashes have it; no shingle: zero."""
    n = len(found)
    if not n:
        return 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, n)
    spread = _SPREAD[hashes.astype("<u8").view(np.uint8).reshape(n, 8)]
    # a counter of eight bits holds 255 additions
    sums = np.add.reduceat(spread, np.arange(0, n, 255), axis=0).astype("<u8")
    counts = sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint's 64 bits as a signed long) of every document."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found, "text"):
            fps = [fingerprint(shingles(t or b"", size)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(batches, "doc_id long, fp long")


def block_keys(fp: Column, radius: int, pieces: int) -> Column:
    """One key for each choice of ``pieces - radius`` pieces of the fingerprint.

    ``radius`` differing bits touch that many pieces at most, so the others agree: two fingerprints within the
    radius share the key of at least one choice. More pieces mean more keys of more bits each.
    """
    ends = [BITS * i // pieces for i in range(pieces + 1)]
    masks = []
    for chosen in combinations(range(pieces), pieces - radius):
        mask = sum(((1 << (ends[i + 1] - ends[i])) - 1) << ends[i] for i in chosen)
        masks.append(mask - 2**64 if mask >= 2**63 else mask)
    return F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks))))


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of (n, words) fingerprints: row i holds bit i of all, fingerprint j at bit j % 64 of word j // 64."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros((n, fps.shape[1]), "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def close_at(planes: np.ndarray, offset: int, n: int, radius: int) -> np.ndarray:
    """Positions i < n whose fingerprint differs from the one at i + offset in at most ``radius`` bits.

    Bit i of the counters' words belongs to the pair (i, i + offset). ``radius`` + 1 is a power of two, so that the
    counters' top bit tells that a pair is over it.
    """
    words = -(-n // 64)
    skip, shift = divmod(offset, 64)
    near = planes[:, :words]
    far = planes[:, skip : skip + words + 1]
    if far.shape[1] < words + 1:
        far = np.pad(far, ((0, 0), (0, words + 1 - far.shape[1])))
    width = (radius + 1).bit_length()
    at = np.arange(words)
    counters = np.zeros((width, words), np.uint64)
    up, down = np.uint64(shift), np.uint64(64 - shift)
    for start in range(0, len(planes), 8):
        for i in range(start, start + 8):
            moved = far[i, at] if not shift else (far[i, at] >> up) | (far[i, at + 1] << down)
            carry = near[i, at] ^ moved
            for c in range(width - 1):  # carry-save: add one bit to every pair's counter
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            counters[-1] |= carry  # stays set
        if start + 8 <= radius:
            continue
        left = counters[-1] != np.uint64(0xFFFFFFFFFFFFFFFF)
        if 2 * left.sum() < len(left):  # abandon words whose pairs are all too far apart
            at, counters = at[left], counters[:, left]
            if not len(at):
                return np.empty(0, np.int64)
    bits = np.unpackbits((~counters[-1]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    found = at[row] * 64 + bit
    return found[found < n]


def links_in_blocks(fps: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Positions linked inside blocks of the given sizes, which stand one after the other, largest first.

    Of each block's links, only those are returned that join two sets not joined before, so there are fewer links
    than fingerprints, with the same connected components.
    """
    ends = np.cumsum(sizes)
    block_end = np.repeat(ends, sizes)
    planes, found = _planes(fps), []
    label = np.arange(len(fps))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for offset in range(1, int(sizes[0]) if len(sizes) else 0):
        n = int(ends[np.searchsorted(-sizes, -offset, side="left") - 1])  # blocks with more than `offset` rows
        close = close_at(planes, offset, n, radius)
        close = close[close + offset < block_end[close]]
        for i in close[label[close] != label[close + offset]]:
            a, b = root(int(i)), root(int(i) + offset)
            if a != b:
                label[max(a, b)] = min(a, b)
                found.append((int(i), int(i) + offset))
    return np.array(found, np.int64).reshape(-1, 2)


def deal(rows: DataFrame, by: list[str], most: int, spread: str, lone: bool = False) -> DataFrame:
    """Rows in groups (``by``, p, q) of about ``most`` at most, in which any two rows of a key meet. Single rows go.

    A larger key is dealt by a hash of ``spread`` into parts of about half of that, and every two parts are a group,
    so no task's memory follows a key's size and no pair is missed. With ``lone`` single rows stay, and only larger keys
    are looked up, which are few, so that rows are not shuffled here (this runs a job): for keys that seldom stand alone.
    """
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > (most if lone else 1))
    cut = F.when(F.col("_n") <= most, 1).otherwise(F.ceil(F.col("_n") / (most // 2))).cast("int")
    mine = F.pmod(F.xxhash64(spread, F.lit(7)), F.col("_cut")).cast("int")
    others = F.when(F.col("_cut") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("_cut") - 1), F.array(F.col("_mine"))))
    dealt = rows.join(small(stage(sizes, "sizes")), by, "left") if lone else rows.join(sizes, by)
    dealt = dealt.withColumn("_cut", F.coalesce(cut, F.lit(1)) if lone else cut).withColumn("_mine", mine).withColumn("_other", F.explode(others))
    return dealt.withColumn("p", F.least("_mine", "_other")).withColumn("q", F.greatest("_mine", "_other")).drop("_n", "_cut", "_mine", "_other")


def grouped(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a group next to each other, groups spread over the shuffle's partitions."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *by).sortWithinPartitions(*by)


def links(keyed: DataFrame, radius: int, block: int, lone: bool = False) -> DataFrame:
    """Links (a, b) between ``node``s that share a block (choice, bits), with all components of the full relation.

    ``keyed`` has a row for each node and block, with the fingerprint's words in ``words`` (array<long>). ``lone`` is
    that of ``deal``.
    """
    dealt = deal(keyed, ["choice", "bits"], block, "node", lone)
    by = ["choice", "bits", "p", "q"]

    def out(rows: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(rows)])
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 1]
        if not len(order):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
        sizes, starts = sizes[order], starts[order]
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        linked = links_in_blocks(rows[at, 5:].view(np.uint64), sizes, radius)
        nodes = rows[at, 4]
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked[:, 0]]), pa.array(nodes[linked[:, 1]])], ["a", "b"])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in found:
            if not batch.num_rows:
                continue
            words = batch.column("words").flatten().to_numpy().reshape(batch.num_rows, -1)
            kept.append(np.column_stack([*(batch.column(c).to_numpy().astype(np.int64) for c in [*by, "node"]), words]))
            held += batch.num_rows
            if held < 100_000:
                continue
            rows = np.concatenate(kept)
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last block may go on in the next batch
            if cut:
                yield out(rows[:cut])
            kept, held = [rows[cut:]], len(rows) - cut
        if kept:
            yield out(np.concatenate(kept))

    return grouped(dealt.select(*by, "node", "words"), by).mapInArrow(batches, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, pieces: int = 5, block: int = 4096) -> DataFrame:
    """One row per document: doc_id, ``fingerprint`` (16 hex digits), ``component_id``. Runs jobs.

    Two documents are linked if their fingerprints differ in at most ``radius`` bits; component_id is the smallest
    doc_id that can be reached over links. Equal fingerprints are one node, so exact copies cost nothing more.

    ``radius`` + 1 is a power of two. NULL, empty and blank texts have fingerprint zero and are linked like any other. A NULL doc_id never names a
    component (NULL only where no member has an id). Repeated rows each return. Other columns are ignored.
    """
    rows = stage(fingerprints(docs, size), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    keyed = nodes.select(F.col("fp").alias("node"), F.array("fp").alias("words"), block_keys(F.col("fp"), radius, pieces).alias("k")).select("node", "words", "k.*")
    roots = stage(components(links(keyed, radius, block), "a", "b"), "roots")
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(nodes["fp"], "first", F.coalesce("root", nodes["fp"]).alias("root"))
    names = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(names, "root").select(F.col("fp").alias("of"), "component_id")
    return rows.join(named, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
