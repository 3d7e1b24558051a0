"""Harmonic packing of tokenized documents into sequences of fixed capacity.

Pieces are classed by the reciprocal of their share of the capacity: pieces of class k are at most capacity / k
and more than capacity / (k + 1) long, and a bin of class k takes exactly k of them. Of a document full sequences are
cut off first. A tail that would leave much of its share empty is cut once or twice at the upper limit of some class
(``cut_plan``), and the last part goes to the class it belongs to.

Workers fill bins of their own with a fixed number of pieces each and know sequence and offset at once. What is left
open at their ends (fewer than k pieces a class) is numbered over all workers by adding up counts, a few numbers for
each worker, and fills bins of k again. Fewer than k pieces a class remain then in the whole, a number that depends on
the capacity alone; they are laid first-fit, longest first.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from probestats.llm.shared import parts, small
from probestats.operators.stage import stage

END = 1  # closes every document
PLAIN_MARKS = ".,;:!?"
#: Words that are tokenized in one call: what the tokenizer returns takes some 1,000 bytes a word.
CALL_WORDS = 4096
#: Words of letters that are one text of such a call, which takes less than half the time of as many texts.
TEXT_WORDS = 64
DIGEST = np.dtype([("a", "<u8"), ("b", "<u8")])


class WordTokenizer:
    """Ids of whole texts from a tokenizer file whose tokens never reach over white space.

    Each distinct word is tokenized once and the texts' ids are put together from the words' ids. Words are
    remembered between batches by a digest of 128 bits, in arrays, and forgotten when they are more than ``most``.
    A word after whose last letter stands plain punctuation is two, since letters and punctuation are never in one
    token; words of A-Z are lowered, as the tokenizer does. A letter that lowers to more than a letter (as the dotted
    capital I, whose dot joins what follows) keeps its word whole.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self._tokenizer, self._most = Tokenizer.from_file(path), most
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        self._closes = None  # of tokenizers that mark a word's last token: whether an id is such a token's
        if suffix:
            vocab = self._tokenizer.get_vocab()
            self._closes = np.zeros(max(vocab.values()) + 1, bool)
            self._closes[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self._keys = np.empty(0, DIGEST)  # sorted by their first half
        self._start, self._size = np.empty(0, np.int64), np.empty(0, np.int32)
        self._flat = np.empty(0, np.uint32)

    def _places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of each word's ids in ``_flat``."""
        keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), DIGEST)
        at, known = self._find(keys)
        if not known.all():
            if len(self._keys) > self._most:
                self._forget()
                known = np.zeros(len(keys), bool)
            new = np.flatnonzero(~known)
            plain = np.fromiter((self._closes is not None and w.isascii() and w.isalpha() for w in map(words.__getitem__, new.tolist())), bool, len(new))
            new = np.r_[new[plain], new[~plain]]
            some = [words[i] for i in new.tolist()]
            (one, ids), (other, more) = self._joined(some[: plain.sum()]), self._single(some[plain.sum() :])
            size = np.r_[one, other]
            start = len(self._flat) + np.cumsum(size) - size
            self._flat = np.concatenate([self._flat, ids, more])
            order = np.argsort(keys["a"][new], kind="stable")
            where = np.searchsorted(self._keys["a"], keys["a"][new][order])
            self._keys = np.insert(self._keys, where, keys[new][order])
            self._start = np.insert(self._start, where, start[order])
            self._size = np.insert(self._size, where, size[order])
            at, _ = self._find(keys)
        return self._start[at], self._size[at]

    def _single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids."""
        sizes, found = [np.empty(0, np.int32)], [np.empty(0, np.uint32)]
        for at in range(0, len(words), CALL_WORDS):
            ids = [e.ids for e in self._tokenizer.encode_batch_fast(words[at : at + CALL_WORDS], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int32, len(ids)))
            found.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        return np.concatenate(sizes), np.concatenate(found)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of letters, in texts of many: their ids end where a token closes a word."""
        texts = [" ".join(words[at : at + TEXT_WORDS]) for at in range(0, len(words), TEXT_WORDS)]
        ids = np.concatenate([np.empty(0, np.uint32), *(self._single(texts[at : at + CALL_WORDS // TEXT_WORDS])[1] for at in range(0, len(texts), CALL_WORDS // TEXT_WORDS))])
        ends = np.flatnonzero(self._closes[ids]) if len(ids) else np.empty(0, np.int64)
        if len(ends) != len(words) or len(ids) and ends[-1] != len(ids) - 1:  # some word is more than one to the tokenizer
            return self._single(words)
        return np.diff(np.r_[-1, ends]).astype(np.int32), ids

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self._keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self._keys["a"], keys["a"]), len(self._keys) - 1)
        return at, self._keys[at] == keys

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, with ``END`` after each text, and the number of ids of each text."""
        split = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        parts_, halves = all_halves(coded.dictionary)
        start, size = self._places(parts_)
        del parts_
        flat = np.append(self._flat, np.uint32(END))
        start, size = np.append(start, len(flat) - 1), np.append(size, np.int32(1))
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        items = halves[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        del split, coded, halves
        items = np.insert(items, 2 * ends, len(start) - 1)
        n = size[items]
        upto = np.cumsum(n)  # 64 bits: a text may have any length
        sizes = np.diff(np.r_[0, upto[2 * ends + np.arange(len(ends))]])
        kind = np.int32 if max(len(flat), sizes.sum()) < 1 << 30 else np.int64
        where = np.repeat(start.astype(kind)[items] - (upto - n).astype(kind), n)
        del items, n, upto
        where += np.arange(len(where), dtype=kind)
        return flat[where], sizes


def _halves(word: str) -> tuple[str, str]:
    """A word as (word, plain punctuation after its last letter)."""
    core = word.rstrip(PLAIN_MARKS)
    if not core or not core[-1].isalpha() or len(core[-1].lower()) > 1:
        return word, ""
    return core.lower() if core.isascii() and core.isalpha() else core, word[len(core) :]


def all_halves(words: pa.LargeStringArray) -> tuple[list[str], np.ndarray]:
    """Different strings, and the numbers among them of each word's ``_halves``; words are no slice of a larger array.

    Most words end in a letter of A-Z, a digit or the like, or do before plain punctuation: they are halved in columns.
    """
    core = pc.utf8_rtrim(words, PLAIN_MARKS)
    length, whole = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (core, words))
    _, ends, data = core.buffers()
    ends = np.frombuffer(ends, np.int64)[core.offset + 1 :][: len(core)]
    last = np.zeros(len(core), np.uint8)
    if length.any():
        last[length > 0] = np.frombuffer(data, np.uint8)[ends[length > 0] - 1]
    is_letter = (last | 32) - 97 < 26  # of 8 bits: what is less than 97 wraps around
    front = pc.if_else(pa.array(is_letter), core, words)
    front = pc.if_else(pc.ascii_is_alpha(core), pc.utf8_lower(core), front)
    cut = np.flatnonzero(is_letter & (length < whole))
    back = dict(zip(cut.tolist(), (w[n - m :] for w, n, m in zip(words.take(pa.array(cut)).to_numpy(zero_copy_only=False), length[cut].tolist(), whole[cut].tolist(), strict=True)), strict=True))
    if (other := np.flatnonzero(last > 127)).size:
        fronts = []
        for i, w in zip(other.tolist(), words.take(pa.array(other)).to_numpy(zero_copy_only=False), strict=True):
            half, back[i] = _halves(w)
            fronts.append(half)
        front = pc.replace_with_mask(front, pa.array(last > 127), pa.array(fronts, front.type))
    backs = list(dict.fromkeys(["", *back.values()]))
    coded = pa.concat_arrays([front, pa.array(backs, front.type)]).dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    number = dict(zip(backs, at[len(words) :].tolist(), strict=True))
    out = np.full((len(words), 2), number[""], np.int32)
    out[:, 0] = at[: len(words)]
    if back:
        out[list(back), 1] = [number[x] for x in back.values()]
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), out  # pyarrow's own lists take ten times as long


@cache
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker, which serves many tasks."""
    return WordTokenizer(path)


@cache
def cut_plan(capacity: int, most: int = 2) -> list[list[int]]:
    """For up to ``most`` cuts, and then for fewer: the length to cut off the front of each length below ``capacity``, a class limit, or 0 for none.

    A piece of class k wastes the difference to capacity / k. Cuts are made where each saves more than a 256th of the
    capacity.
    """
    length = np.arange(1, capacity + 1)
    plain = np.r_[0, capacity / (capacity // length) - length]
    limits = np.unique(capacity // length)[:-1]
    cost, plans = plain, []
    for _ in range(most):
        before, cost, first = cost, plain.copy(), np.zeros(capacity + 1, np.int64)
        for limit in limits.tolist():
            rest = np.arange(limit + 1, capacity)
            with_cut = plain[limit] + before[rest - limit] + capacity / 256
            better = with_cut < cost[rest]
            first[rest[better]], cost[rest[better]] = limit, with_cut[better]
        plans.insert(0, first[:capacity].tolist())
    return plans


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full sequences, then the tail in one to three."""
    rest = n % capacity
    out = [capacity] * (n // capacity)
    for plan in cut_plan(capacity):
        if plan[rest]:
            out.append(plan[rest])
            rest -= plan[rest]
    return [*out, rest] if rest else out


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
NAMES = [c.split()[0] for c in PIECE.split(", ")]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Every document's pieces with class ``k``, worker, sequence_id and offset. In a worker's open bins sequence_id is NULL and ``nth`` counts its pieces of the class."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = tokenizer(tokenizer_path)
        worker, bins = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple]] = {}  # the open bins: fewer than k pieces each
        for batch in parts(found, "text", 2_000_000):  # the worker may hold other stages' memory
            ids, sizes = tokenize(batch.column("text"))
            ids = ids.astype("<u4", copy=False)
            rows, size, at = [], 0, 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                start = 0
                for length in cuts(n, capacity):
                    piece = ids[at + start : at + start + length]
                    k = capacity // length
                    bin_ = held.setdefault(k, [])
                    bin_.append((doc, start, length, zlib.crc32(piece), n, piece.copy() if keep_ids else None))
                    start += length
                    if len(bin_) == k:
                        offset = 0
                        for nth, p in enumerate(held.pop(k)):
                            rows.append((*p[:5], k, worker, nth, (bins << 22 | worker) * 4, offset, p[5]))
                            offset += p[2]
                        bins, size = bins + 1, size + offset
                at += n
                if keep_ids and size > 1_000_000:
                    yield _as_batch(rows, keep_ids)
                    rows, size = [], 0
            if rows:
                yield _as_batch(rows, keep_ids)
        rows = [(*p[:5], k, worker, nth, None, None, p[5]) for k, bin_ in held.items() for nth, p in enumerate(bin_)]
        if rows:
            yield _as_batch(rows, keep_ids)

    kind = f"{PIECE}, k long, worker long, nth long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, kind)


def _as_batch(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    *columns, kept = zip(*rows, strict=True)
    arrays = [pa.array(c, pa.int64()) for c in columns]
    names = [*NAMES, "k", "worker", "nth", "sequence_id", "offset"]
    if keep_ids:
        ends = np.r_[0, np.cumsum([len(x) for x in kept])].astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece: the longest first, each in the first bin with room for it."""
    used: list[int] = []
    out = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bin_ = next((b for b, u in enumerate(used) if u + lengths[i] <= capacity), len(used))
        if bin_ == len(used):
            used.append(0)
        out[i] = (bin_, used[bin_])
        used[bin_] += lengths[i]
    return out


def _rest(rows: DataFrame, capacity: int) -> DataFrame:
    """Sequences of the last pieces of all classes: fewer than k each, so a few thousand in all."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in found if b.num_rows]
        if not held:
            return
        all_ = pa.Table.from_batches(held).sort_by([("k", "ascending"), ("at", "ascending")])
        placed = first_fit(all_.column("length").to_pylist(), capacity)
        all_ = all_.drop_columns(["k", "at"])
        all_ = all_.add_column(5, "sequence_id", pa.array([b * 4 + 2 for b, _ in placed], pa.int64()))
        yield from all_.add_column(6, "offset", pa.array([o for _, o in placed], pa.int64())).combine_chunks().to_batches()

    kind = f"{PIECE}, sequence_id long, offset long" + (", ids array<int>" if "ids" in rows.columns else "")
    return rows.repartition(1).mapInArrow(batches, kind)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids``). Runs jobs.

    ``capacity`` must be a power of two. Sequences are at most that long; what is missing is padding.

    NULL and empty texts are the closing id alone. Repeated rows are packed each. A NULL doc_id stays NULL. Other
    columns are ignored. An empty table gives no rows.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    kept = ["ids"] if keep_ids else []
    out = [*NAMES, "sequence_id", "offset", *kept]
    found = stage(pieces(docs, tokenizer_path, capacity, keep_ids), "pieces")
    left = found.where("sequence_id IS NULL")
    counts = left.groupBy("k", "worker").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("k")
    earlier = by_class.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("k", "worker", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(by_class).alias("all"))
    left = left.drop("sequence_id", "offset").join(small(stage(counts, "counts")), ["k", "worker"])
    left = left.withColumn("at", F.col("before") + F.col("nth")).withColumn("bin", F.expr("at div k"))
    whole = (F.col("bin") + 1) * F.col("k") <= F.col("all")
    before = Window.partitionBy("k", "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # k pieces
    filled = left.where(whole).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    filled = filled.withColumn("sequence_id", (F.col("bin") * (capacity + 1) + F.col("k")) * 4 + 1)
    rest = _rest(left.where(~whole).select(*NAMES, *kept, "k", "at"), capacity)
    return found.where("sequence_id IS NOT NULL").select(out).union(filled.select(out)).union(rest.select(out))


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences of ``pack(..., keep_ids=True)``: sequence_id and ``ids``; a group is one sequence."""
    together = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(together, lambda x: x["ids"])).alias("ids"))
