"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(group | history) P(class | group, history) P(word | class). Classes are runs of words in the
order of their last letters, each with about the same share of the tokens; sixteen neighbouring classes are a group.
The first two factors are softmaxes of sixteen ways over hashed features of the history: the word before (bigram),
the words two and three before (skips), and the two words before together (trigram). Words are counted exactly over
all training documents; within a class they share its mass by their counts plus one, one more share being kept for
words never seen.

The weights are trained by gradient updates on the executors: each task descends on its own documents, and the
changes are averaged per weight row over the tasks that touched it. Rounds take disjoint parts of the documents, so
all rounds together read every training document once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from probestats.llm.shared import crc_of_id, parts
from probestats.operators.stage import stage

WAYS = 16
CLASSES = WAYS * WAYS
CODE_BITS = 18
END = 0  # hash of the token that closes every text
GROUP_ROWS, CLASS_ROWS = 1 << 15, 1 << 16  # numbered with 16 bits
BLOCK = 256  # weight rows that travel together
BATCH = 16_384
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def suffix_codes(words: list[str]) -> np.ndarray:
    """Six bits for each of a word's last three characters, the last one first: neighbours end alike."""
    padded = "".join(f"\0\0{w[-3:]}" for w in words)
    sizes = np.fromiter((min(3, len(w)) for w in words), np.int64, len(words)) + 2
    chars = np.frombuffer(padded.encode("utf-32-le"), np.uint32).astype(np.int64)
    folded = np.where(chars == 0, 0, np.where((chars >= 97) & (chars <= 122), chars - 96, 27 + chars % 37))
    ends = np.cumsum(sizes)
    return folded[ends - 1] << 12 | folded[ends - 2] << 6 | folded[ends - 3]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of tokens, their suffix codes, token numbers in text order, each text's end)."""
    split = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    # bytes.lower() changes A-Z only; words that differ in case keep numbers of their own but share the hash
    words = [w.lower() for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    there = np.array([bool(w) for w in words], bool)[numbers] if words else np.empty(0, bool)
    ends = np.r_[0, np.cumsum(there)][np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]
    numbers = np.insert(numbers[there], ends, len(words))
    return np.r_[hashes, END].astype(np.int64), np.r_[suffix_codes([w.decode() for w in words]) if words else np.empty(0, np.int64), 0], numbers, ends + np.arange(1, len(ends) + 1)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, code, n) of every token of the texts."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found, "text"):
            hashes, codes, numbers, _ = tokens(batch.column("text"))
            n = np.bincount(numbers, minlength=len(hashes))
            seen = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(hashes[seen]), pa.array(codes[seen].astype(np.int32)), pa.array(n[seen])], ["h", "code", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(batches, "h long, code int, n long")
    return counted.groupBy("h").agg(F.first("code").alias("code"), F.sum("n").alias("n"))


@dataclass
class Model:
    head: np.ndarray  # sorted hashes of frequent words
    head_n: np.ndarray  # their counts
    class_of: np.ndarray  # class of each suffix code
    mass: np.ndarray  # of each class: tokens, distinct words and one
    n_tokens: int
    n_words: int
    groups: np.ndarray  # weights: feature row x group
    classes: np.ndarray  # weights: feature and group row x class of the group

    def of_words(self, hashes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, count in the head (-1: not in it) and feature key of distinct tokens."""
        cls = self.class_of[codes]
        n = np.full(len(hashes), -1, np.int64)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
            n = np.where(self.head[at] == hashes, self.head_n[at], -1)
        # a rare word stands for its class
        key = np.where(n >= 0, hashes.view(np.uint64), (cls + 1).astype(np.uint64) * _B)
        return cls, n, (key ^ (key >> np.uint64(31))) * _A

    def features(self, keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(feature, token) hashes of each token's history, which ends at its text's start."""
        before = []
        place = np.arange(len(keys)) - starts
        for back in (1, 2, 3):
            shifted = np.full(len(keys), back, np.uint64)
            shifted[back:] = keys[: len(keys) - back] if back < len(keys) else 0
            shifted[place < back] = back
            before.append(shifted)
        one, two, three = before
        two_skip = two * _B
        mixed = np.stack([np.zeros_like(one), one, two_skip, three * _B + np.uint64(17), (one * _A + two_skip) * _B])
        mixed ^= mixed >> np.uint64(29)
        mixed *= _A
        mixed ^= mixed >> np.uint64(32)
        return mixed


def _rows(features: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of the two softmaxes, one line for each feature."""
    one = (features & np.uint64(GROUP_ROWS - 1)).astype(np.uint16)
    two = (((features >> np.uint64(20)) + group.astype(np.uint64) * np.uint64(40503)) & np.uint64(CLASS_ROWS - 1)).astype(np.uint16)
    return one, two


def _log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(way, token) log probabilities; the ways come first, as sums over long lines are fast."""
    logits = weights.take(rows[0], axis=0)
    for line in rows[1:]:
        logits += weights.take(line, axis=0)
    logits = np.ascontiguousarray(logits.T)
    logits -= logits.max(axis=0)
    logits -= np.log(np.exp(logits).sum(axis=0))
    return logits


def _step(weights: np.ndarray, squares: np.ndarray, touched: np.ndarray, rows: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One gradient update of a softmax on a batch of tokens (Adagrad)."""
    error = -np.exp(_log_softmax(weights, rows))
    error[target, np.arange(len(target))] += 1
    flat = rows.ravel()  # 16 bits, which sort by counting
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[first, len(flat)])
    token = order % len(target)
    # most rows have one token, whose error is taken as it is; only the others are summed
    g = np.ascontiguousarray(error.T).take(token[first], axis=0)
    many = sizes > 1
    if many.any():
        runs = np.cumsum(sizes[many]) - sizes[many]
        g[many] = np.add.reduceat(error.take(token[np.repeat(many, sizes)], axis=1), runs, axis=1).T
    used = ordered[first]
    s = squares.take(used, axis=0) + g * g
    squares[used] = s
    g *= rate
    g /= np.sqrt(s, out=s)
    weights[used] += g
    touched[used] += sizes


def _descend(docs: DataFrame, model: Model, rate: float) -> DataFrame:
    """Each task's changes to the weights, in blocks of rows: (block, change x touches, touches)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables = sent.value, None
        for batch in parts(found, "text"):
            if tables is None:
                tables = [(w.copy(), np.full_like(w, 1.0), np.zeros(len(w), np.float32)) for w in (model.groups, model.classes)]
            hashes, codes, numbers, ends = tokens(batch.column("text"))
            cls, _, keys = model.of_words(hashes, codes)
            starts = np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, ends]))
            y, features = cls[numbers], model.features(keys[numbers], starts)
            for a in range(0, len(y), BATCH):
                group = y[a : a + BATCH] // WAYS
                rows = _rows(features[:, a : a + BATCH], group)
                _step(*tables[0], rows[0], group, rate)
                _step(*tables[1], rows[1], y[a : a + BATCH] % WAYS, rate)
        if tables:
            change = np.concatenate([(t[0] - w) * t[2][:, None] for t, w in zip(tables, (model.groups, model.classes), strict=True)])
            touched = np.concatenate([t[2] for t in tables])
            some = np.flatnonzero(touched.reshape(-1, BLOCK).any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([change[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in some], pa.binary()), pa.array([touched[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in some], pa.binary())],
                ["block", "change", "touched"],
            )

    def add(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}  # at most as many as there are blocks
        for batch in found:
            for block, *both in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                arrays = [np.frombuffer(x, np.float32).astype(np.float64) for x in both]
                sums[block] = [s + x for s, x in zip(sums[block], arrays, strict=True)] if block in sums else arrays
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array([s[i].tobytes() for s in sums.values()], pa.binary()) for i in (0, 1))], ["block", "change", "touched"])

    kind = "block int, change binary, touched binary"
    tasks = min((GROUP_ROWS + CLASS_ROWS) // BLOCK, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return docs.select(F.col("text").cast("string")).mapInArrow(batches, kind).repartition(tasks, "block").mapInArrow(add, kind)


def train(docs: DataFrame, learn: Column, rounds: int = 2, head: int = 1 << 18, rate: float = 0.4) -> tuple[Model, DataFrame]:
    """The model and the counts (h, code, n) of all training tokens. Runs jobs.

    What the driver holds is bounded: ``head`` frequent words, the mass of 2^18 suffix codes, and the weights.
    """
    known = docs.where(learn)
    counts = stage(count_words(known), "words")
    by_code = counts.groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    mass, words = np.zeros(1 << CODE_BITS, np.int64), np.zeros(1 << CODE_BITS, np.int64)
    mass[by_code["code"].to_numpy()], words[by_code["code"].to_numpy()] = by_code["n"].to_numpy(), by_code["words"].to_numpy()
    total = int(mass.sum())
    middle = np.cumsum(mass) - mass / 2
    class_of = np.minimum(middle * CLASSES / max(total, 1), CLASSES - 1).astype(np.int64)
    of_class = [np.bincount(class_of, x, CLASSES).astype(np.int64) for x in (mass, words)]
    frequent = _most_frequent(counts, head)
    order = np.argsort(frequent["h"].to_numpy())
    model = Model(
        frequent["h"].to_numpy()[order], frequent["n"].to_numpy()[order], class_of, of_class[0] + of_class[1] + 1, total, int(words.sum()),
        np.zeros((GROUP_ROWS, WAYS), np.float32), np.zeros((CLASS_ROWS, WAYS), np.float32),
    )
    for r in range(rounds if total else 0):
        some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r)
        for row in _descend(some, model, rate / (r + 1)).toLocalIterator():
            change, touched = np.frombuffer(row["change"]).reshape(BLOCK, WAYS), np.frombuffer(row["touched"])
            table, at = (model.groups, row["block"] * BLOCK) if row["block"] * BLOCK < GROUP_ROWS else (model.classes, row["block"] * BLOCK - GROUP_ROWS)
            table[at : at + BLOCK] += (change / np.maximum(touched, 1)[:, None]).astype(np.float32)
    return model, counts


def _most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """At most ``most`` words: all from that count on from which on there are not more. Only their rows leave the executors."""
    scale = (F.log2(F.col("n").cast("double")) * 16).cast("int")
    found = counts.groupBy(scale.alias("scale")).count().orderBy(F.desc("scale")).collect()  # a thousand rows at most
    least, held = None, 0
    for row in found:
        held += row["count"]
        if held > most:
            break
        least = row["scale"]
    return (counts.where(scale >= least) if least is not None else counts.limit(0)).select("h", "n").toArrow()


def evaluate(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: row (a number of its own), doc_id, n_tokens, known and log_n of its frequent words, log10 of the
    class probabilities less the classes' mass, and its other words with their number of occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = sent.value, TaskContext.get().partitionId() << 40
        log_mass = np.log10(model.mass)
        for batch in parts(found, "text", 4_000_000):
            hashes, codes, numbers, ends = tokens(batch.column("text"))
            cls, n, keys = model.of_words(hashes, codes)
            sizes = np.diff(np.r_[0, ends])
            first = ends - sizes
            doc = np.repeat(np.arange(len(sizes)), sizes)
            y, token_keys, starts = cls[numbers], keys[numbers], np.repeat(first, sizes)
            score = -log_mass[y]
            for a in range(0, len(y), BATCH):
                # the history of a slice's first tokens lies before it
                b, lead = min(a + BATCH, len(y)), max(0, a - 3)
                features = model.features(token_keys[lead:b], starts[lead:b] - lead)[:, a - lead :]
                group, at = y[a:b] // WAYS, np.arange(b - a)
                rows = _rows(features, group)
                score[a:b] += (_log_softmax(model.groups, rows[0])[group, at] + _log_softmax(model.classes, rows[1])[y[a:b] % WAYS, at]) / np.log(10)
            count = n[numbers]
            inside = count >= 0
            log_n = np.where(inside, np.log10(np.maximum(count, 0) + 1.0), 0)
            pair, often = np.unique(doc[~inside] * len(hashes) + numbers[~inside], return_counts=True)
            upto = np.searchsorted(pair // max(1, len(hashes)), np.arange(len(sizes) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(x)) for x in (hashes[pair % max(1, len(hashes))], often.astype(np.int32))]
            sums = [np.bincount(doc, x, len(sizes)) for x in (inside & (count > 0), log_n, score)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(sizes))), batch.column("doc_id"), pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), *lists],
                ["row", "doc_id", "n_tokens", "known", "log_n", "class_score", "h", "often"],
            )
            row += len(sizes)

    kind = "row long, doc_id long, n_tokens long, known long, log_n double, class_score double, h array<long>, often array<int>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, kind)


def score(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """One row per document: doc_id, ``held_out``, n_tokens, n_known, train_tokens, base_score, ``score``. Runs jobs.

    Learns from rows whose CRC-32 of doc_id modulo 7 is not 2. Both scores are log10 probabilities over the same
    tokens; ``base_score`` is that of counts plus one.

    NULL and empty texts are the closing token alone. NULL doc_id: scored, never learned from, not held out.
    Repeated rows count and return each. Other columns are ignored; an empty table gives no rows. With nothing to
    learn from, base_score is 0.
    """
    model, counts = train(docs, crc_of_id() % 7 != 2, rounds)
    found = stage(evaluate(docs, model), "scores")
    rare = found.select("row", F.arrays_zip("h", "often").alias("z")).select("row", F.explode("z").alias("z")).select("row", "z.h", "z.often")
    # frequent words, which would be hot keys, were looked up within the tasks; a word is a key at most once a document
    n = F.coalesce("n", F.lit(0))
    looked = rare.join(counts.select("h", "n"), "h", "left").groupBy("row").agg(
        F.sum(F.col("often") * F.log10(n + 1.0)).alias("rare_log_n"), F.sum(F.when(n > 0, F.col("often")).otherwise(0)).alias("rare_known")
    )
    log_n = F.col("log_n") + F.coalesce("rare_log_n", F.lit(0.0))
    whole = float(np.log10(model.n_tokens + model.n_words + 1.0))
    return found.drop("h", "often").join(looked, "row", "left").select(
        "doc_id", F.coalesce(crc_of_id() % 7 == 2, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (log_n - F.col("n_tokens") * whole).alias("base_score"), (log_n + F.col("class_score")).alias("score"),
    )
