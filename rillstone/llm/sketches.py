"""MinHash near-dedup by SetSketch registers.

A register is the floor of a logarithm of the least of exponentially distributed values of a document's shingles, cut to a byte. Such minima are
mergeable and equal with a probability near the Jaccard similarity. Values of one shingle come as a Poisson process whose points fall
on registers at random, so that a shingle stops as soon as its points lie beyond all registers.

Plan: documents with equal shingle sets form a class. Bands of a class' registers are hashed; a small bucket gives its pairs whose likelihood
estimate of the similarity is not far below the threshold, a large one a star round its first class. Components of these candidates are clusters.
Inside a cluster intersections are exact, over full shingle sets of one text for each class, and links give components. A cluster of more than CHUNK classes is
dealt in chunks that share a few pivots; then classes outside the largest component so far, if any, meet all chunks. So a large group of
copies takes work in proportion to its size, no task holds more than two chunks, and no list of pairs is made of a group. Classes that look alike without being
linked (one template, other values) are outside each other's components: n of them take n * n / CHUNK rows of verification.

Rows are numbered and written once, so that a class' text is found by the number of its first row, however often it is repeated.

Defined results: a null or empty text has no shingles and links with nothing; a text of fewer words than a shingle has one, all its words; rows with
equal texts, or the same row repeated, are linked with each other; a null doc_id is its own component unless linked to others, and never the name
of one; texts of any length are taken whole; an empty table gives no rows; other columns are ignored, or pass through in drop_near_duplicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, own_name, small_batches, sole_memory, table, tidied
from .components import components, forest

BASE, SHIFT = 1.1, 25
#: Classes of a bucket up to which all its pairs are looked at, and of a cluster in one chunk.
BUCKET, CHUNK = 24, 384
PIVOTS = 4
#: Pairs are dropped before verification only if the estimate is this far below the threshold (5 standard errors).
SLACK = 0.16
#: Words that a worker remembers before it starts anew, and the longest one it does.
CACHE_WORDS, CACHE_BYTES = 400_000, 64
_G = np.uint64(0x9E3779B97F4A7C15)
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_words: dict[bytes, int] = {}


def banding(threshold: float) -> tuple[int, int]:
    """Rows and bands: a pair at the threshold shares a band with a probability of at least 1 - 3e-6."""
    rows = 6 if threshold >= 0.85 else 5 if threshold >= 0.8 else 4
    bands = int(np.ceil(np.log(3e-6) / np.log1p(-(threshold**rows))))
    return rows, bands


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    try:
        h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_words) > CACHE_WORDS:
            _words.clear()
        local = {w: _words.get(w) or xxh3_64_intdigest(w) for w in set(words)}
        if len(local) < CACHE_WORDS // 2:
            _words.update((w, x) for w, x in local.items() if len(w) <= CACHE_BYTES)
        h = np.fromiter(map(local.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    s = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        s = _mix(s + h[i : i + n] + _G)
    return np.unique(s)


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """uint8 (len(sets), m); sets must not be empty."""
    out = np.full((len(sets), m), np.inf)
    flat = out.reshape(-1)
    h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x, j, block = np.zeros(len(h)), 0, 1
    while len(h):
        step = (np.arange(j + 1, j + block + 1, dtype=np.uint64) * _G)[None, :]
        z = _mix(h[:, None] + step)
        points = x[:, None] + np.cumsum(-np.log(((z >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52), axis=1) / m
        place = doc[:, None] * m + (_mix(z ^ _G) % np.uint64(m)).astype(np.int64)
        np.minimum.at(flat, place.ravel(), points.ravel())
        x, j = points[:, -1], j + block
        go = x < out.max(axis=1)[doc]
        h, doc, x = h[go], doc[go], x[go]
        block = min(64, max(1, 2 * block if j >= 2 else 1))
    return np.clip(np.floor(SHIFT + 1 - np.log(out) / np.log(BASE)), 0, 255).astype(np.uint8)


def similarity_floor(threshold: float) -> float:
    return threshold - SLACK


def _sketch(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memory("sketches", _words.clear)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [shingles(t.as_py(), k) for t in part.column(1)]
                full = [i for i, s in enumerate(sets) if len(s)]
                regs = registers([sets[i] for i in full], m)
                sizes, own = [len(s) for s in sets], [None] * len(sets)
                f1, f2 = [0] * len(sets), [0] * len(sets)
                for r, i in zip(regs, full, strict=True):
                    own[i] = r.tobytes()
                    digest = blake2b(sets[i].tobytes(), digest_size=16).digest()
                    f1[i], f2[i] = (int.from_bytes(d, "little", signed=True) for d in (digest[:8], digest[8:]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "uid", "n_shingles", "f1", "f2", "regs"])

    return tidied(run, _words.clear)


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> float:
    """Most likely Jaccard similarity of two sets of known sizes, from how many registers of a are above, below and equal to b's.

    With u = n_a / (n_a + n_b) and v = 1 - u a register of a is above b's with p(u - v j), below with p(v - u j), where p(x) = -log_b(1 - x (b - 1) / b).
    """
    m = len(a)
    up, down = int((a > b).sum()), int((a < b).sum())
    u, v = na / (na + nb), nb / (na + nb)
    j = np.linspace(0, min(u / v, v / u), 201)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    pu, pd = np.clip(p(u - v * j), 1e-9, 1), np.clip(p(v - u * j), 1e-9, 1)
    pe = np.clip(1 - pu - pd, 1e-9, 1)
    return float(j[np.argmax(up * np.log(pu) + down * np.log(pd) + (m - up - down) * np.log(pe))])


def _likely(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [x.to_pylist() for x in batch.columns]
            keep = [i for i in range(batch.num_rows) if estimate(np.frombuffer(c[2][i], np.uint8), np.frombuffer(c[3][i], np.uint8), c[4][i], c[5][i]) >= floor]
            yield batch.take(pa.array(keep, pa.int64())).select([0, 1])

    return run


def candidates(classes: DataFrame, rows: int, bands: int, floor: float) -> DataFrame:
    """Pairs (a, b) of classes (cid, n_shingles, regs) that join clusters."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 1 + i * rows, rows)) for i in range(bands)])
    banded = classes.select("cid", F.explode(keys).alias("key"))
    shared = cut(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("n > 1"))
    more = shared.filter("n > 2").select("key", "n", "lo").join(banded, "key")
    few = more.filter(F.col("n") <= BUCKET).groupBy("key").agg(F.sort_array(F.collect_list("cid")).alias("c"))
    few = few.select(F.explode(F.expr("flatten(transform(c, (x, i) -> transform(slice(c, i + 2, size(c)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    pairs = shared.filter("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(few).distinct()
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("regs").alias(f"r_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "r_a", "r_b", "n_a", "n_b").mapInArrow(_likely(floor), "a long, b long")
    stars = more.filter((F.col("n") > BUCKET) & (F.col("cid") != F.col("lo"))).select(F.col("lo").alias("a"), F.col("cid").alias("b")).distinct()
    return likely.unionByName(stars)


def _links(sets: list[np.ndarray], ratio: tuple[int, int], first: int | None = None) -> np.ndarray:
    """Boolean matrix of exact links; with first, of the first so many sets against all."""
    n = len(sets)
    rows = n if first is None else first
    size = np.asarray([len(s) for s in sets], np.int64)
    token, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    new = np.r_[True, token[1:] != token[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # tokens of one set meet no other
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    both = np.zeros((rows, n), np.int64)
    width = min(max(256, 8_000_000 // n), int(column.max()) + 1 if len(column) else 1)
    for lo in range(0, (int(column.max()) + 1) if len(column) else 0, width):
        at = slice(*np.searchsorted(column, (lo, lo + width)))
        block = np.zeros((n, width), np.float32)
        block[owner[at], column[at] - lo] = 1
        both += np.rint(block[:rows] @ block.T).astype(np.int64)
    return ratio[1] * both >= ratio[0] * (size[:rows, None] + size[None, :] - both)


def grouped(batches: Iterator[pa.RecordBatch], plain: bool = True) -> Iterator:
    """The rows of each value of column job, of batches that are sorted by it; plain: as lists by name, else as a table."""
    own = lambda parts: pa.Table.from_batches(parts).to_pydict() if plain else pa.Table.from_batches(parts)
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        jobs = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(jobs[1:] != jobs[:-1]) + 1).tolist(), len(jobs)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(lo, hi - lo)
            if held and held[-1].column(0)[0] != part.column(0)[0]:
                yield own(held)
                held = []
            held.append(part)
    if held:
        yield own(held)


def _verify(k: int, ratio: tuple[int, int]):
    """Rows job, cid, side, text -> edges (a, b). Side 0 meets side 0 and 1; side 1 is not compared with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for g in grouped(batches):
            # A pivot of its own chunk comes twice.
            rows = sorted({c: (s, c, t) for c, s, t in sorted(zip(g["cid"], g["side"], g["text"], strict=True), key=lambda r: -r[1])}.values(), key=lambda r: r[:2])
            if len(rows) > 1:
                first = sum(r[0] == 0 for r in rows)
                sets = [shingles(r[2], k) for r in rows]
                links = _links(sets, ratio, first)
                full = np.zeros((len(rows), len(rows)), bool)
                full[:first] = links
                for i, r in enumerate(forest(len(rows), *np.nonzero(full)).tolist()):
                    if r != i:
                        a.append(rows[i][1])
                        b.append(rows[r][1])
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return tidied(run, _words.clear)


def _jobs(members: DataFrame, texts: DataFrame, check: Callable) -> DataFrame:
    """members (job, cid, side) with their texts, job by job."""
    parts = members.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = members.join(texts, "cid").select("job", "cid", "side", "text")
    return small_batches(rows.repartition(int(parts), "job").sortWithinPartitions("job")).mapInArrow(check, "a long, b long")


def link_classes(classes: DataFrame, docs: DataFrame, k: int, ratio: tuple[int, int], chunk: int = CHUNK) -> DataFrame:
    """classes (cid, n_shingles, regs), docs (uid, text; a class' cid is the uid of one of its rows) -> node, root of components of exact links (classes without links may lack)."""
    threshold = ratio[0] / ratio[1]
    rows, bands = banding(threshold)
    clusters = cut(components(candidates(classes, rows, bands, similarity_floor(threshold)))).select(F.col("node").alias("cid"), "root")
    texts = cut(clusters.join(docs.select(F.col("uid").alias("cid"), "text"), "cid").select("cid", "root", "text"))
    sizes = texts.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    dealt = texts.select("cid", "root").join(sizes, "root").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("long")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("chunks")))
    dealt = cut(dealt)
    pivots = dealt.filter("chunks > 1").select("root", "chunks", "cid")
    pivots = pivots.groupBy("root", "chunks").agg(*[F.min(F.struct(F.xxhash64(F.lit(i), "cid").alias("h"), "cid")).alias(f"p{i}") for i in range(PIVOTS)])
    pivots = _spread(pivots)
    job = lambda *c: F.xxhash64(*c)
    members = dealt.select(job("root", "own").alias("job"), "cid", F.lit(0).alias("side")).unionByName(pivots.select(job("root", "own").alias("job"), "cid", F.lit(0).alias("side")))
    one = texts.select("cid", "text")
    edges = cut(_jobs(members, one, _verify(k, ratio)))
    large = dealt.filter("chunks > 1")
    if large.isEmpty():
        return components(edges)
    labels = components(edges)
    found = large.join(labels.select(F.col("node").alias("cid"), F.col("root").alias("comp")), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    sizes = found.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("k"))
    giant = sizes.groupBy("root").agg(F.max(F.struct("k", "comp")).alias("g"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("root", F.col("g.comp").alias("giant"), F.col("g.k").alias("giant_n"))
    open_ = cut(found.join(giant, "root"))
    # What is outside the largest component meets everything of its cluster, chunk by chunk.
    out = open_.filter("comp <> giant").withColumn("outs", F.ceil((F.col("n") - F.col("giant_n")) / chunk).cast("long")).withColumn("mine", F.pmod(F.xxhash64(F.lit(1), "cid"), F.col("outs")))
    left = out.select("root", "cid", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("own"))
    right = open_.select("root", "cid", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("n") - F.col("giant_n")) / chunk).cast("long") - 1)).alias("mine"))
    members = left.select(job("root", "mine", "own").alias("job"), "cid", F.lit(0).alias("side")).unionByName(right.select(job("root", "mine", "own").alias("job"), "cid", F.lit(1).alias("side")))
    return components(edges.unionByName(_jobs(members, one, _verify(k, ratio))))


def _spread(pivots: DataFrame) -> DataFrame:
    """Each cluster's pivots, once for each of its chunks."""
    own = pivots.select("root", "chunks", F.explode(F.array_distinct(F.array(*[F.col(f"p{i}.cid") for i in range(PIVOTS)]))).alias("cid"))
    return own.select("root", "cid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("own"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row in uid, written down: the numbers stay what they are when a task is run again."""
    return cut(docs.withColumn("uid", F.monotonically_increasing_id()))


def _components(docs: DataFrame, k: int, ratio: tuple[int, int], chunk: int) -> DataFrame:
    """docs (uid, doc_id, text) -> per row doc_id, uid, n_shingles, and of its component name (the smallest doc_id) and keeper (the uid of that document's first row); both null for a row without shingles."""
    rows, bands = banding(ratio[0] / ratio[1])
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "uid")
    sk = cut(small_batches(narrow).mapInArrow(_sketch(k, rows * bands), "doc_id long, uid long, n_shingles long, f1 long, f2 long, regs binary"))
    sets = sk.filter("n_shingles > 0")
    # Rows without an id come last, so that they name no component with others in it.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid"))
    classes = sets.groupBy("f1", "f2").agg(F.min("uid").alias("cid"), first.alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.join(sets.select(F.col("uid").alias("cid"), "n_shingles", "regs"), "cid"))
    roots = cut(link_classes(classes, docs, k, ratio, chunk))
    joined = classes.select("cid", "f1", "f2", "first", "copies").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    names = joined.filter("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    named = joined.filter("root is not null or copies > 1").join(names, "root", "left").select("f1", "f2", F.coalesce("least", "first").alias("least"))
    out = sk.select("doc_id", "uid", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    alone = F.col("least").isNull()
    return out.select("doc_id", "uid", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("name"), F.when(alone, F.col("uid")).otherwise(F.col("least.uid")).alias("keeper"))


def near_duplicates(docs: DataFrame, k: int = 5, ratio: tuple[int, int] = (80, 100), chunk: int = CHUNK) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id linked to, directly or not), kept (whether that is the own one)."""
    found = _components(numbered(docs.select("doc_id", "text")), k, ratio, chunk)
    return found.select("doc_id", "n_shingles", F.col("name").alias("component_id"), F.col("name").eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, ratio: tuple[int, int] = (80, 100), chunk: int = CHUNK) -> DataFrame:
    """One row of each group, the first of the smallest doc_id, with all its columns; rows without words all stay."""
    uid = own_name(docs, "uid")
    rows = cut(docs.withColumn(uid, F.monotonically_increasing_id()))
    found = _components(rows.select(F.col("doc_id"), "text", F.col(uid).alias("uid")), k, ratio, chunk)
    return rows.join(found.filter("uid = keeper").select(F.col("uid").alias(uid)), uid).select(*docs.columns)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, (85, 100)).select("doc_id", "n_shingles", "component_id", "kept")
