"""Connected components of a graph of any size, by alternating large-star and small-star steps.

Each step is a plan of many exchanges, and the driver pays for every plan: threads, generated classes, metrics. So
edges that lie in one task are joined there first: a graph of a few partitions is done after one step or none. What
the plans of a step leave in the driver is dropped before the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from probestats.operators.stage import free_driver, stage

#: Edges that a task joins at a time.
LOCAL = 250_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that is not the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)  # labels are roots here: each is tied to the smallest root next to it
        while (label[label] != label).any():
            label = label[label]
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[tied], nodes[label[tied]]


def _joined(edges: DataFrame, most: int) -> DataFrame:
    """Edges with the same components, no more than before, with ``b`` less than ``a``: each task ties its own, ``most`` at a time."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in found:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                held.append([part.column(c).to_numpy() for c in ("a", "b")])
                n += part.num_rows
                if n >= most:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)

    def out(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        tied = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in tied], ["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(batches, "a long, b long")


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Tie each node's larger (``small``: smaller) neighbours to the smallest node next to it or itself.

    ``b`` is less than ``a`` in each edge, before and after. Minima are pre-aggregated before the shuffle and joined back
    to the edges many to one, so that a node with very many edges is never gathered in one place.
    """
    if small:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        sides = edges.select(F.explode(both).alias("e")).select("e.*")
    least = sides.groupBy(F.col("u").alias("of")).agg(F.least(F.min("v"), F.col("of")).alias("m"))
    tied = sides.join(least, F.col("u") == F.col("of"))
    if small:
        out = tied.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    else:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node is tied once and none is tied to a tied one, so that ``b`` is the root of ``a``. Runs a job."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("of"), F.lit(1).alias("tied")), F.struct(F.col("b").alias("of"), F.lit(0).alias("tied")))).alias("e")).select("e.*")
    found = ends.groupBy("of").agg(F.sum("tied").alias("_n"), F.min("tied").alias("_least"))
    return not found.agg(F.count_if((F.col("_n") > 1) | ((F.col("_n") == 1) & (F.col("_least") == 0)))).first()[0]


def components(edges: DataFrame, left: str, right: str, most: int = LOCAL) -> DataFrame:
    """(node, root) for every node of the edges, root being the component's smallest node. Runs jobs.

    Nodes are numbers. Each round halves the depth of long chains; rounds go on until every edge leads to a root. They
    are written to the shared folder, so that a lost executor costs one round at most. A task joins ``most`` edges at a
    time.
    """
    first = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct()
    now = stage(_joined(first, most), "edges")
    free_driver(now.sparkSession)
    while not _settled(now):
        now = stage(_joined(_star(_star(now, small=False), small=True), most), "stars")
        free_driver(now.sparkSession)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
