"""Connected components of an edge list: in one pass where the counted edges fit a task, by alternating large and small stars beyond."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return r.n, r.s


#: Edges (16 bytes each) up to which one task links them all.
ONE_TASK = 1_000_000


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of the component of each of n nodes with edges i, j."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for at in (i, j, root[i], root[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _in_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    a, b = (np.concatenate([h[i] for h in held] or [np.empty(0, np.int64)]) for i in (0, 1))
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    root = nodes[forest(len(nodes), at[: len(a)], at[len(a) :])] if len(nodes) else nodes
    for lo in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + 50_000]), pa.array(root[lo : lo + 50_000])], names=["node", "root"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """edges (a long, b long; any order, repeats and loops allowed) -> node, root (the smallest node of its component), one row per node.

    Every round is cut from its lineage by a checkpoint. A node's neighbours meet only in partial minima, never in one list.
    """
    loops = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    loops = cut(loops)
    if loops.count() <= one_task:
        return loops.coalesce(1).mapInArrow(_in_one, "node long, root long")
    e = cut(loops.filter("a <> b").distinct())
    alone = loops.filter("a = b").select(F.col("a").alias("node"))
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        e = cut(small.filter("a <> b").distinct())
        before, state = state, _state(e)
        if state == before:
            break
    labels = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    roots = labels.select(F.col("root").alias("node"), "root").distinct()
    known = labels.unionByName(roots)
    return known.unionByName(alone.distinct().join(known, "node", "left_anti").select("node", F.col("node").alias("root")))
