"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared checkpoint folder, without lineage.

    The folder is the session's spark.checkpoint.dir; only where that is unset and all runs in one process (tests) a local one is made.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="rillstone-"))
    return df.checkpoint(eager=True)


#: Rows and bytes of the Arrow batches that Python workers get; one bound for all operators, as the session has one setting for all its queries.
BATCH_ROWS, BATCH_BYTES = 2000, "8m"


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the Arrow batches that Python workers get by rows and, where Spark can, by bytes."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


_memories: dict[str, Callable[[], None]] = {}


def sole_memory(owner: str, clear: Callable[[], None]) -> None:
    """A worker process outlives stages: what other operators remember in it is dropped when owner begins."""
    for name, drop in _memories.items():
        if name != owner:
            drop()
    _memories[owner] = clear


def give_back() -> None:
    """Freed memory of this process back to the system, where its C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidied(run: Callable[[Iterator], Iterator], clear: Callable[[], None] = lambda: None) -> Callable[[Iterator], Iterator]:
    """run, at whose end a worker process keeps nothing: workers idle on beside tasks that need no Python."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            clear()
            give_back()

    return whole


#: Keys with more than this share of all rows are heavy; there are fewer of them than its inverse, whatever the data.
HEAVY = 1 / 2000


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], n: int, count: str = "c") -> DataFrame:
    """rows (n of them) joined with keyed, which holds a key once, with the number of its rows in count.

    The heavy keys, fewer than 1 / HEAVY rows of keyed, are broadcast and their rows stay where they are; the rest is shuffled, at most n * HEAVY rows a key.
    """
    heavy = F.col(count) > max(1.0, n * HEAVY)
    more = [c for c in keyed.columns if c not in keys]
    here = rows.join(F.broadcast(keyed.filter(heavy)), keys, "left")
    there = here.filter(F.col(count).isNull()).select(*rows.columns).join(keyed.filter(~heavy), keys)
    return here.filter(F.col(count).isNotNull()).select(*rows.columns, *more).unionByName(there.select(*rows.columns, *more))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def once(value: Column) -> Column:
    """The same value, which the optimiser does not copy into each place that uses it, lambdas included: it keeps what is not deterministic where it is."""
    return F.when(F.rand(0) >= 0, value)


def own_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores ahead, so that no column of df is hidden."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
