"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct character n-grams of its words, each worth the log ratio of its share of the
toxic documents' n-grams to its share of the others'. Counts come from all labelled training documents. A logistic
regression on the features tells which of them to trust.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from probestats.llm.shared import crc_of_id, first_ids, parts, small
from probestats.llm.wordgrams import char_ngrams, coded_words
from probestats.operators.stage import stage

LOW, HIGH = 3, 6


def document_ngrams(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram) pairs, each once, in the order of documents; with ``known`` (sorted hashes) positions in it instead of hashes."""
    words, codes, ends = coded_words(texts)
    n = np.diff(np.r_[0, ends])
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hashes, owner = char_ngrams(words, LOW, HIGH)
    if known is not None:
        if not len(known):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.zeros(1 << 22, bool)
        maybe[known >> np.uint64(42)] = True
        some = np.flatnonzero(maybe[hashes >> np.uint64(42)])
        at = np.minimum(np.searchsorted(known, hashes[some]), len(known) - 1)
        hit = known[at] == hashes[some]
        hashes, owner = at[hit].astype(np.uint64), owner[some[hit]]
    doc = np.repeat(np.arange(len(n)), n)
    pairs = np.unique(np.stack([doc, codes]), axis=1) if len(doc) < 50_000 else _distinct(doc, codes, len(words))
    # each document's distinct words, then their n-grams
    size = np.bincount(owner, minlength=len(words))
    first = np.cumsum(size) - size
    k = size[pairs[1]]
    at = np.repeat(first[pairs[1]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
    docs, found = np.repeat(pairs[0], k), hashes[at]
    order = np.lexsort((found, docs))
    docs, found = docs[order], found[order]
    new = np.r_[True, (docs[1:] != docs[:-1]) | (found[1:] != found[:-1])] if len(docs) else np.empty(0, bool)
    return docs[new], found[new]


def _distinct(doc: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
    keys = np.unique(doc * words + word)
    return np.stack([keys // words, keys % words])


@dataclass
class Toxicity:
    ngrams: np.ndarray  # sorted hashes
    weight: np.ndarray  # weight x log ratio of each
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        docs, at = document_ngrams(texts, self.ngrams)
        z = self.bias + np.bincount(docs, self.weight[at.astype(np.int64)], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn) -> DataFrame:
    """text and label of the documents to learn from; labels that repeat a doc_id count once, as toxic if one says so."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("of")).agg((F.max(label) > 0).alias("toxic"))
    texts = docs.where(learn).select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(small(known), F.col("doc_id") == F.col("of")).select("doc_id", "text", "toxic")


def log_ratios(rows: DataFrame, features: int, least: int = 3, least_ratio: float = 1.0, smoothing: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The ``features`` n-grams that tell most (by the likelihood ratio of their counts), sorted, and their log-count ratios.

    Counts are over all rows. Left out are n-grams in fewer than ``least`` documents, and those whose log ratio is
    under ``least_ratio``: a long text has very many that speak mildly for either side, and few that speak for one.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found, "text", 2_000_000):
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            docs, grams = document_ngrams(batch.column("text"))
            own, where = np.unique(grams, return_inverse=True)
            p = np.bincount(where, toxic[docs], len(own)).astype(np.int64)
            q = np.bincount(where, ~toxic[docs], len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.uint64).view(np.int64)), pa.array(p), pa.array(q)], ["gram", "p", "q"])
            # documents of each class, under no n-gram
            totals = [pa.nulls(1, pa.int64()), pa.array([int(toxic.sum())], pa.int64()), pa.array([int((~toxic).sum())], pa.int64())]
            yield pa.RecordBatch.from_arrays(totals, ["gram", "p", "q"])

    counts = rows.select("text", "toxic").mapInArrow(batches, "gram long, p long, q long").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    counts = stage(counts, "ngrams")  # read for the sums and for the ratios
    docs_row = F.col("gram").isNull()
    sums = counts.agg(
        F.sum(F.when(docs_row, F.col("p"))).alias("np"), F.sum(F.when(docs_row, F.col("q"))).alias("nq"),
        F.sum(F.when(~docs_row, F.col("p") + smoothing)).alias("sp"), F.sum(F.when(~docs_row, F.col("q") + smoothing)).alias("sq"),
    )
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    cell = lambda x, n: F.when(x > 0, x * F.log(x / n)).otherwise(0.0)
    tells = (
        cell(p, F.col("np")) + cell(q, F.col("nq")) + cell(F.col("np") - p, F.col("np")) + cell(F.col("nq") - q, F.col("nq"))
        - (cell(p + q, F.col("np") + F.col("nq")) + cell(F.col("np") + F.col("nq") - p - q, F.col("np") + F.col("nq")))
    )
    ratio = F.log((p + smoothing) / F.col("sp")) - F.log((q + smoothing) / F.col("sq"))
    told = counts.where(~docs_row & (F.col("p") + F.col("q") >= least)).crossJoin(F.broadcast(sums)).where(ratio >= least_ratio)  # one row
    best = told.select("gram", ratio.alias("r"), tells.alias("t")).orderBy(F.desc("t"), "gram").limit(features).collect()
    grams = np.array([r["gram"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.array([r["r"] for r in best], np.float64)[order]


def training_rows(rows: DataFrame, ngrams: np.ndarray, rows_per_class: int) -> list[tuple[bool, list[int]]]:
    """Features of at most ``rows_per_class`` ids of each class, the first in hash order."""
    sent = rows.sparkSession.sparkContext.broadcast(ngrams)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found, "text", 2_000_000):
            docs, at = document_ngrams(batch.column("text"), sent.value)
            ends = np.r_[0, np.cumsum(np.bincount(docs, minlength=batch.num_rows))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), lists], ["doc_id", "toxic", "at"])

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic")
    out = []
    for toxic in (True, False):
        some = found.where(F.col("toxic") == toxic)
        ids = first_ids(some, "toxic", rows_per_class).select("doc_id")
        # at most rows_per_class ids are broadcast
        chosen = some.join(F.broadcast(ids.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
        # one row for each id, however often it is repeated
        chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
        out += [(r["toxic"], r["at"]) for r in chosen.mapInArrow(batches, "doc_id long, toxic boolean, at array<int>").collect()]
    return out


def fit(rows: list[tuple[bool, list[int]]], ngrams: np.ndarray, ratios: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> Toxicity:
    """Logistic regression on the scaled features, both classes weighing alike, by Adam on all rows."""
    y = np.array([t for t, _ in rows], float)
    if not len(rows) or y.min() == y.max():
        return Toxicity(ngrams[:0], ratios[:0], -4.0 if not len(rows) or not y.max() else 4.0)
    sizes = np.array([len(a) for _, a in rows])
    column = np.concatenate([np.asarray(a, np.int64) for _, a in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    x = ratios[column]
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(len(ngrams)), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, x * w[column], len(rows))
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.r_[np.bincount(column, x * error[row], len(w)) + decay * w, error.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Toxicity(ngrams, w * ratios, float(b))


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id and ``score`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found, "text", 2_000_000):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.scores(batch.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", features: int = 8_192, rows_per_class: int = 10_000) -> Toxicity:
    """Learn from the labelled rows whose CRC-32 of doc_id modulo 3 is not 1. Counts take all of them; the regression at most ``rows_per_class`` of each class."""
    rows = labelled(docs, labels, label, crc_of_id() % 3 != 1)
    ngrams, ratios = log_ratios(rows, features)
    return fit(training_rows(rows, ngrams, rows_per_class), ngrams, ratios)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7, **how) -> DataFrame:
    """One row per document: doc_id, ``held_out``, ``score``, ``predicted``. Fits first.

    NULL and empty texts are scored by the bias alone. NULL doc_id: scored, never learned from, not held out.
    Repeated rows return each. Other columns are ignored; an empty table gives no rows. Without labels of both
    classes every document gets the same score, near the only class there is (0 if there is none).
    """
    held = F.coalesce(crc_of_id() % 3 == 1, F.lit(False))
    scored = score(docs, train(docs, labels, label, **how))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
