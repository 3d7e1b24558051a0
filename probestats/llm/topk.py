"""Exact search for the vectors with the greatest inner products, by statistics of segments, coarse to fine.

A vector is cut into segments; of each its mean and deviation are known. The squared distance of two vectors is at least the
sum over segments of length * ((difference of means)^2 + (difference of deviations)^2), so their inner product, half of both
squared lengths less the squared distance, is at most the sum of length * (product of means + product of deviations). This
is asked with few segments first and with more for those that are left; the exact product is computed for what survives.

Vectors are dealt into blocks. Each query is answered in its own block first; its k-th best score there goes with it
to all other blocks as the bound to beat.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from probestats.operators.stage import stage

SEGMENTS = (1, 4, 16)
#: Most vectors in a block, which one task holds; blocks are smaller where that keeps up to ``TASKS`` tasks busy.
BLOCK, LEAST_BLOCK, TASKS = 131_072, 2_048, 48
QUERIES_AT_ONCE = 32
#: A level that leaves more than this share is followed by the next one for all vectors, which is cheaper than picking.
DENSE = 0.2
_LONG = 2**63 - 1
_FOUND = ["query_id", "vec_id", "score", "tau"]


def _matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows, filled up with zeros (or cut) to ``width``, the longest one's if not given."""
    n = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    longest = int(n.max()) if len(n) else 0
    if len(n) and (n == longest).all():
        out = values.reshape(len(n), longest)
    else:
        out = np.zeros((len(n), longest), np.int64)
        out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = values
    if width is None or width == longest:
        return out
    return np.pad(out, ((0, 0), (0, max(0, width - longest))))[:, :width]


class Block:
    """Vectors of whole numbers with their segment statistics."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.width = ids, vectors.shape[1]
        self.most = int(np.abs(vectors).max(initial=0))
        self.vectors = self._exact(vectors)
        self.edges = [np.unique(np.linspace(0, self.width, s + 1).astype(int)) for s in SEGMENTS if s <= self.width]
        kind = np.float32 if self.most < 2**20 else np.float64
        self.levels = [self.statistics(vectors, e).astype(kind) for e in self.edges]
        self.norm = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(1).max(initial=0.0)))

    def _exact(self, vectors: np.ndarray) -> np.ndarray:
        """In the smallest type in which sums of products are exact; Python numbers if none is."""
        bound = self.width * max(self.most, 1) ** 2
        return vectors.astype(np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object)

    @staticmethod
    def statistics(vectors: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Per segment the mean and the deviation, each times the root of the segment's length."""
        v, n = vectors.astype(np.float64), np.diff(edges)
        total = np.add.reduceat(v, edges[:-1], axis=1)
        squares = np.add.reduceat(v * v, edges[:-1], axis=1)
        return np.concatenate([total / np.sqrt(n), np.sqrt(np.maximum(squares - total * total / n, 0.0))], axis=1)

    def best(self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query (id, ids, scores) of the ``k`` greatest scores not below its bound, itself left out."""
        if not self.width or not len(self.ids):
            for q, bound in zip(query_ids.tolist(), bounds.tolist(), strict=True):
                ids = np.sort(self.ids[self.ids != q])[:k] if bound <= 0 else self.ids[:0]
                yield q, ids, np.zeros(len(ids), np.int64)
            return
        most = max(self.most, int(np.abs(queries).max(initial=0)))
        wide = self.width * max(most, 1) ** 2
        kind = np.float32 if wide < 2**24 else np.float64 if wide < 2**53 else object
        vectors = self.vectors if self.vectors.dtype == kind else self.vectors.astype(np.int64 if kind is object else kind).astype(kind)
        exact = queries.astype(kind)
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        stats = [self.statistics(queries, e).astype(np.float32 if most < 2**20 else np.float64) for e in self.edges]
        for first in range(0, len(queries), QUERIES_AT_ONCE):
            part = slice(first, first + QUERIES_AT_ONCE)
            own, bound = query_ids[part], bounds[part].copy()
            slack = 0.5 + 1e-5 * norms[part] * self.norm  # scores are whole; the rest is for rounding
            upper = stats[0][part] @ self.levels[0].T
            if len(self.ids) > 4 * k:  # first bounds from the vectors that promise most
                for r in np.flatnonzero(bound == -np.inf):
                    near = np.argpartition(-upper[r], 4 * k)[: 4 * k]
                    near = near[self.ids[near] != own[r]]
                    bound[r] = np.partition((vectors[near] @ exact[first + r]).astype(np.float64), -k)[-k]
                    bound[r] -= 1e-9 * abs(bound[r]) if kind is object else 0
            left = upper >= (bound - slack)[:, None]
            done = 1  # levels looked at
            while done < len(self.levels) and left.mean() > DENSE:
                left = stats[done][part] @ self.levels[done].T >= (bound - slack)[:, None]
                done += 1
            every = exact[part] @ vectors.T if left.mean() > DENSE else None
            for r in range(len(own)):
                at = np.flatnonzero(left[r])
                if every is None:
                    for level, stat in zip(self.levels[done:], stats[done:], strict=True):
                        at = at[level[at] @ stat[first + r] >= bound[r] - slack[r]]
                    scores = vectors[at] @ exact[first + r]
                else:
                    scores = every[r][at]
                keep = scores >= bound[r]
                at, scores = at[keep], scores[keep]
                other = self.ids[at] != own[r]
                at, scores = at[other], scores[other]
                if kind is object:
                    scores = np.array([max(-_LONG - 1, min(_LONG, int(s))) for s in scores], np.int64)
                else:
                    scores = scores.astype(np.int64)
                if len(scores) > k:
                    keep = scores >= np.partition(scores, -k)[-k]
                    at, scores = at[keep], scores[keep]
                ids = self.ids[at]
                o = np.lexsort((ids, -scores))[:k]
                yield int(own[r]), ids[o], scores[o]


def _blocks(found: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Iterator[pa.RecordBatch]]]:
    """Each block of rows sorted by block and ``tau`` (NULL, a vector, before queries), with its queries in batches."""
    rows = _of_one_block(found)
    batch = next(rows, None)
    while batch is not None:
        block, held = batch.column("block")[0], []
        while batch is not None and batch.column("block")[0] == block and not batch.column("is_query")[0].as_py():
            held.append(batch)
            batch = next(rows, None)
        ids = np.concatenate([b.column("vec_id").to_numpy() for b in held]) if held else np.empty(0, np.int64)
        matrices = [b.column("v") for b in held]
        built = Block(ids, _matrix(pa.concat_arrays(matrices)) if matrices else np.empty((0, 0), np.int64))
        del held, matrices
        waiting: list[pa.RecordBatch] = []

        def queries(block=block, waiting=waiting) -> Iterator[pa.RecordBatch]:
            nonlocal batch
            while batch is not None and batch.column("block")[0] == block:
                yield batch
                batch = next(rows, None)

        yield built, queries()


def _of_one_block(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold one block and one kind of row each."""
    for batch in found:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy() * 2 + batch.column("is_query").to_numpy(zero_copy_only=False)
        edges = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def _answers(answers: Iterator[tuple[int, np.ndarray, np.ndarray]], k: int, first: bool) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for q, ids, scores in answers:
        tau = int(scores[-1]) if len(scores) == k else None
        if first and not len(ids):  # the query itself has to be known
            rows.append((q, None, None, None))
        rows += [(q, i, s, tau) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        if len(rows) > 50_000:
            yield _as_batch(rows)
            rows = []
    if rows:
        yield _as_batch(rows)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _FOUND)


def whole_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, ``v``: floor(scale * component), one row per id; without vectors that have no part in the search."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return rows.select(F.col("vec_id").cast("long"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, block: int = BLOCK) -> DataFrame:
    """The ``k`` vectors of the greatest inner product for every vector whose id is divisible by ``every``. Runs jobs.

    query_id, rank (from 1), vec_id, score (of the vectors' floor(scale * component), exact). The query itself is left
    out; ties go to the smaller vec_id; fewer than ``k`` others give as many rows as there are.

    No part take: NULL vec_id, NULL vectors and vectors with a NULL or non-finite component. Rows of one vec_id are one
    vector, the least of them in array order. A shorter vector counts as filled up with zeros, an empty one scores 0.
    Scores beyond a long are its bounds. Other columns are ignored. Empty table: no rows.
    """
    found = stage(whole_vectors(vectors, scale), "vectors")
    n = found.count()
    n_blocks = max(ceil(n / block), min(TASKS, ceil(n / min(block, LEAST_BLOCK))), 1)
    rows = found.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    is_query = F.col("vec_id") % every == 0
    kind = ", ".join(f"{c} long" for c in _FOUND)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _ in _blocks(batches):
            asked = own.ids % every == 0
            queries = own.vectors[asked].astype(np.int64)
            yield from _answers(own.best(own.ids[asked], queries, np.full(len(queries), -np.inf), k), k, True)

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, queries in _blocks(batches):
            for batch in queries:
                bounds = batch.column("tau").cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                bounds = bounds - 1e-9 * np.abs(np.where(np.isfinite(bounds) & (np.abs(bounds) > 2**53), bounds, 0))
                yield from _answers(own.best(batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), own.width), bounds, k), k, False)

    vectors_ = rows.select("block", F.lit(False).alias("is_query"), "vec_id", F.lit(None).cast("long").alias("tau"), "v")
    home = stage(_dealt(vectors_, n_blocks).mapInArrow(at_home, kind), "home")
    best = home.where(F.col("vec_id").isNotNull())
    if n_blocks > 1:
        taus = home.groupBy("query_id").agg(F.max("tau").alias("tau"))
        queries = rows.where(is_query).join(taus, F.col("vec_id") == F.col("query_id"))
        others = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other")
        sent = queries.select("*", others).where(F.col("other") != F.col("block"))
        sent = sent.select(F.col("other").alias("block"), F.lit(True).alias("is_query"), "vec_id", "tau", "v")
        best = best.unionByName(_dealt(vectors_.unionByName(sent), n_blocks).mapInArrow(elsewhere, kind))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _dealt(rows: DataFrame, n_blocks: int) -> DataFrame:
    """One block a task, vectors before queries."""
    return rows.repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "is_query")
