"""Embedding near-dedup by spherical k-means cells and blocked cosine products.

Centroids are fitted on at most SAMPLE vectors, taken by hash order; every vector is assigned. A vector also visits those cells with a smaller number that a linked vector
could lie in: a vector of cell b lies on b's side of the plane between two centroids, so x of cell a can be within the angle t of it only if
x . (c_a - c_b) / |c_a - c_b| <= sin t. This bound is exact, so no link is lost whatever the
centroids. Cells are dealt in blocks of BLOCK members; a job multiplies two blocks in double precision, slab by slab, and returns counts of links and a star for each component, never
pairs. A vector travels once for each block it meets, so blocks are as large as a task's memory easily holds (two of 64 numbers a vector take 17 MB). Equal vectors are one class with a count.

The number of centroids is bounded by the sample (SAMPLE / EACH); beyond, cells grow, and their blocks keep tasks bounded. Vectors without any clusters are in reach of
most cells at this threshold, and work is then that of all blocks against all.

Defined results: a vector that is null, empty or zero or holds a null or non-finite component has no links, and is its own component; vectors of different lengths
do not link; repeated rows count as vectors of their own and share a component; a null vec_id is never a component's name unless alone; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .components import components, forest
from .sketches import grouped

#: Vectors that centroids are fitted on, vectors of it for each centroid at least, vectors a cell should hold, vectors in a block.
SAMPLE, EACH, CELL, BLOCK = 20_000, 4, 16_384, 16_384
#: Products are taken so many numbers at a time.
SLAB = 8_000_000


def units(column: pa.ListArray, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids; starts from rows far from each other among a few tries, reruns agree."""
    rng = np.random.default_rng(7)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        norm = np.sqrt((new * new).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-9, new / np.maximum(norm, 1e-9), c)
    return c


def _assign(centroids: dict[int, np.ndarray], threshold: float):
    reach = np.sqrt(1 - threshold * threshold) + 1e-9
    between = {d: np.sqrt(np.maximum(0, 2 - 2 * c @ c.T)) for d, c in centroids.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                c, gap = centroids[int(d)], between[int(d)]
                s = units(part.column(1), int(d)) @ c.T
                own = np.argmax(s, axis=1)
                ahead = s[np.arange(len(own)), own][:, None] - s <= reach * gap[own]
                ahead &= np.arange(len(c))[None, :] < own[:, None]
                visits = pa.ListArray.from_arrays(np.r_[0, np.cumsum(ahead.sum(axis=1))].astype(np.int32), pa.array(np.nonzero(ahead)[1], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(own, pa.int32()), visits], names=["cid", "embedding", "dim", "cell", "visits"])

    return run


def _compare(threshold: float):
    """Rows job, cid, copies, dim, side, embedding -> per class with links in the job: its number of linked vectors and its component's root there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, plain=False):
            side, cid, copies = (g.column(n).to_numpy() for n in ("side", "cid", "copies"))
            order = np.lexsort((cid, side))
            side, cid, copies = side[order], cid[order], copies[order]
            x = units(g.column("embedding").combine_chunks(), int(g.column("dim")[0].as_py()))[order]
            first, n = int((side == 0).sum()), len(cid)
            own = first == n
            if not first or n < 2:
                continue
            links, i_all, j_all = np.zeros(n, np.int64), [], []
            step = max(1, SLAB // n)
            for lo in range(0, first, step):
                hit = x[lo : min(lo + step, first)] @ (x.T if own else x[first:].T) >= threshold
                if own:
                    hit[np.arange(len(hit)), lo + np.arange(len(hit))] = False
                links[lo : lo + len(hit)] += hit @ copies[0 if own else first :]
                if not own:
                    links[first:] += copies[lo : lo + len(hit)] @ hit
                i, j = np.nonzero(hit)
                i, j = i + lo, j + (0 if own else first)
                if len(i) > 4 * n:  # many links: keep what spans the same components
                    roots = forest(n, i, j)
                    i, j = np.flatnonzero(roots != np.arange(n)), roots[roots != np.arange(n)]
                i_all.append(i)
                j_all.append(j)
            roots = forest(n, np.concatenate(i_all), np.concatenate(j_all))
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(links[at]), pa.array(cid[roots[at]])], names=["cid", "links", "root"])

    return run


def link_vectors(vectors: DataFrame, threshold: float = 0.95, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept, one row for each row."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    sound = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, e.cast("array<double>")).alias("embedding"))
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # -0.0 becomes 0.0
    classes = rows.filter("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    by_dim = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()} if not classes.isEmpty() else {}
    if not by_dim:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    centroids = {}
    for dim, n in by_dim.items():
        k = max(1, min(SAMPLE // EACH, -(-n // cell)))
        sample = classes.filter(F.col("dim") == dim).select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks() if k > 1 else None
        centroids[dim] = spherical_k_means(units(sample, dim), k) if k > 1 else np.eye(1, dim)
    placed = cut(small_batches(classes.select("cid", "embedding", "dim")).mapInArrow(_assign(centroids, threshold), "cid long, embedding array<double>, dim int, cell int, visits array<int>"))
    placed = placed.join(classes.select("cid", "copies"), "cid")
    n_home = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    n_visit = placed.select("dim", F.explode("visits").alias("cell")).groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("v"))
    # One row for each cell, at most SAMPLE / EACH for each length of vectors.
    cells = n_home.join(n_visit, ["dim", "cell"], "left").select("dim", "cell", F.ceil(F.col("n") / block).cast("int").alias("nb"), F.ceil(F.coalesce("v", F.lit(0)) / block).cast("int").alias("nv"))
    salt = lambda n, s: F.pmod(F.xxhash64(F.lit(s), "cid"), n).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), n - 1)
    job = lambda g, j: F.xxhash64("dim", "cell", g, j)
    home = placed.join(cells, ["dim", "cell"]).withColumn("mine", salt(F.col("nb"), 1))
    same = F.transform(all_of(F.col("nb")), lambda t: F.struct(job(-1 - F.least("mine", t), F.greatest("mine", t)).alias("job"), F.when(F.col("mine") <= t, 0).otherwise(1).alias("side")))
    other = F.when(F.col("nv") > 0, F.transform(all_of(F.greatest(F.col("nv"), F.lit(1))), lambda t: F.struct(job(t, F.col("mine")).alias("job"), F.lit(1).alias("side")))).otherwise(F.expr("cast(array() as array<struct<job:bigint,side:int>>)"))
    home = home.select("cid", "copies", "dim", "embedding", F.explode(F.concat(same, other)).alias("x"))
    guests = placed.select("cid", "copies", "dim", "embedding", F.explode("visits").alias("cell")).join(cells, ["dim", "cell"]).withColumn("mine", salt(F.col("nv"), 2))
    guests = guests.select("cid", "copies", "dim", "embedding", F.explode(F.transform(all_of(F.col("nb")), lambda t: F.struct(job(F.col("mine"), t).alias("job"), F.lit(0).alias("side")))).alias("x"))
    jobs = home.unionByName(guests).select("x.job", "cid", "copies", "dim", "x.side", F.col("embedding").cast("array<double>").alias("embedding"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(small_batches(jobs.repartition(parts, "job").sortWithinPartitions("job")).mapInArrow(_compare(threshold), "cid long, links long, root long"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.join(links, "cid", "left").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    names = known.groupBy("root").agg(F.min("name").alias("component"))
    known = known.join(names, "root").select(F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    out = rows.join(known, F.col("embedding") == F.col("e"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.col("component").isNull()).alias("kept"))


def op2_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
