"""Keyed tables as snapshots with a change log, transactions and versions. Snapshots are DataFrames; nothing is collected but counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class TableError(KeyError):
    pass


def last_writes(log: DataFrame, key: str, order: str = "_seq", outdated: str = "_outdated") -> DataFrame:
    """The rows that a change log leaves: of each key the last one, unless it is a retraction. One shuffle, partial maxima."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")
    return last.filter(~F.col(outdated)).drop(outdated) if outdated in rest else last


def versions(log: DataFrame, key: str, commit: str = "_tx", outdated: str | None = None) -> DataFrame:
    """Rows with [cts, dts): a version lives from its commit to the key's next one."""
    out = log.withColumn("cts", F.col(commit)).withColumn("dts", F.lead(commit).over(Window.partitionBy(key).orderBy(commit)))
    return out.filter(~F.col(outdated)) if outdated else out


def snapshot(versioned: DataFrame, tx: int | Column) -> DataFrame:
    """What a transaction that begins at tx sees."""
    t = F.lit(tx) if isinstance(tx, int) else tx
    return versioned.filter((F.col("cts") <= t) & (F.col("dts").isNull() | (F.col("dts") > t)))


def committed(log: DataFrame, tx: str, marks: DataFrame) -> DataFrame:
    """The writes of transactions that marks (tx, status) calls committed, in commit order."""
    return log.join(marks.filter(F.col("status") == "commit").select(tx, F.col("cts").alias("_commit")), tx)


def conflicts(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Backward validation: readers (reader, start, key) that must abort as a write set (key, end) was committed after their start."""
    return reads.alias("r").join(writes.alias("w"), (F.col("r.key") == F.col("w.key")) & (F.col("w.end") > F.col("r.start")), "left_semi").select("reader").distinct()


@dataclass
class KeyedTable:
    """One record for each key. Every change goes to the log as Insert, Update or Delete, and to observers."""

    df: DataFrame
    key: str
    log: list[tuple[str, DataFrame]] = field(default_factory=list)
    observers: list[tuple[Callable[[str, DataFrame], None], str]] = field(default_factory=list)
    committed: int = 0

    def _changed(self, op: str, rows: DataFrame) -> None:
        self.log.append((op, rows))
        for tell, mode in self.observers:
            if mode == "immediate":
                tell(op, rows)

    def register_observer(self, tell: Callable[[str, DataFrame], None], mode: str = "immediate") -> None:
        """tell(op, rows) at every change, or (mode 'commit') of all changes since the last commit when commit() is called."""
        if mode not in ("immediate", "commit"):
            raise ValueError(f"no mode is called {mode}")
        self.observers.append((tell, mode))

    def commit(self) -> None:
        fresh, self.committed = self.log[self.committed :], len(self.log)
        for tell, mode in self.observers:
            if mode == "commit":
                for op, rows in fresh:
                    tell(op, rows)

    def _last(self, rows: DataFrame) -> DataFrame:
        """One row for each key, the last by _seq, or as the rows stand."""
        if "_seq" not in rows.columns:
            rows = rows.withColumn("_seq", F.monotonically_increasing_id())
        return last_writes(rows, self.key, outdated="").select(*self.df.columns)

    def insert(self, rows: DataFrame) -> KeyedTable:
        """Of rows with one key the last wins, over the record there was too."""
        new = self._last(rows)
        self.df = self.df.join(new.select(self.key), self.key, "left_anti").select(*self.df.columns).unionByName(new)
        self._changed("Insert", new)
        return self

    def delete_where(self, predicate: Column) -> int:
        gone = self.df.filter(predicate)
        n = gone.count()
        self.df = self.df.filter(~F.coalesce(predicate, F.lit(False)))
        self._changed("Delete", gone)
        return n

    def delete_by_key(self, k) -> int:
        return self.delete_where(F.col(self.key) == k)

    def update_where(self, predicate: Column, **sets: Column) -> int:
        """The log has the records as they are after the update, chosen by what they were before."""
        old = self.df.filter(predicate)
        n = old.count()
        self._changed("Update", old.withColumns(sets) if sets else old)
        self.df = self.df.withColumns({c: F.when(predicate, x).otherwise(F.col(c)) for c, x in sets.items()}) if sets else self.df
        return n

    def update_by_key(self, k, **sets: Column) -> int:
        return self.update_where(F.col(self.key) == k, **sets)

    def update_or_delete_by_key(self, k, keep: Column, sets: dict[str, Column], insert: DataFrame | None = None) -> int:
        """The record of k is updated if keep holds for it then, and deleted otherwise; without one, insert is inserted."""
        own = F.col(self.key) == k
        if self.df.filter(own).isEmpty():
            if insert is None:
                return 0
            self.insert(insert)
            return 1
        if self.df.filter(own).withColumns(sets).filter(keep).isEmpty():
            return self.delete_where(own)
        return self.update_where(own, **sets)

    def fold(self, rows: DataFrame) -> KeyedTable:
        """Rows in order of _seq: each is inserted, or deletes its key if it is _outdated. The last of a key decides."""
        if "_outdated" not in rows.columns:
            return self.insert(rows)
        if "_seq" not in rows.columns:
            rows = rows.withColumn("_seq", F.monotonically_increasing_id())
        last = last_writes(rows, self.key, outdated="")
        new = last.filter(~F.col("_outdated")).select(*self.df.columns)
        gone = self.df.join(last.filter("_outdated").select(self.key), self.key, "left_semi").select(*self.df.columns)
        self.df = self.df.join(last.select(self.key), self.key, "left_anti").select(*self.df.columns).unionByName(new)
        self._changed("Delete", gone)
        self._changed("Insert", new)
        return self

    def update_each(self, rows: DataFrame, key: str, update: Callable, insert: Callable | None = None) -> KeyedTable:
        """update(row, record) -> record or None, insert(row) -> record or None, for each row in order of its key: keys are independent, records of one are a chain."""
        names, own = self.df.columns, self.key

        def run(held: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            record = held[names].to_dict("records")[0] if len(held) else None
            for row in new.sort_values("_seq").to_dict("records"):
                record = update(row, record) if record is not None else insert(row) if insert else None
            return pd.DataFrame([] if record is None else [record], columns=names)

        self.df = self.df.groupBy(own).cogroup(rows.groupBy(key)).applyInPandas(run, self.df.schema)
        touched = rows.select(F.col(key).alias(own)).distinct()
        self._changed("Update", self.df.join(touched, own, "left_semi").select(*names))
        return self

    def get_by_key(self, k):
        row = self.df.filter(F.col(self.key) == k).head()
        if row is None:
            raise TableError(k)
        return row

    def select(self, predicate: Column | None = None) -> DataFrame:
        return self.df if predicate is None else self.df.filter(predicate)

    def size(self) -> int:
        return self.df.count()

    def truncate(self) -> None:
        self._changed("Delete", self.df)
        self.df = self.df.limit(0)

    def changes(self, mode: str = "immediate") -> DataFrame | None:
        """The change log with _op, _outdated (deletes) and _seq, the number of the change; mode 'commit' stops at the last commit."""
        out = None
        for i, (op, rows) in enumerate(self.log if mode == "immediate" else self.log[: self.committed]):
            part = rows.withColumn("_op", F.lit(op)).withColumn("_outdated", F.lit(op == "Delete")).withColumn("_seq", F.lit(i).cast("long"))
            out = part if out is None else out.unionByName(part)
        return out

    def save(self, path: str) -> None:
        """A snapshot under the folder path, ordered by key, so that a key's rows are in few row groups; earlier snapshots stay until they are removed."""
        newest = _newest(self.df.sparkSession, path)
        self.df.withColumn("_version", F.lit(0 if newest is None else newest + 1)).repartitionByRange(self.key).sortWithinPartitions(self.key).write.partitionBy("_version").mode("append").parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str) -> KeyedTable:
        """The newest snapshot."""
        newest = _newest(spark, path)
        if newest is None:
            raise TableError(path)
        return cls(spark.read.parquet(path).filter(F.col("_version") == newest).drop("_version"), key)


def _newest(spark: SparkSession, path: str) -> int | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).agg(F.max("_version")).first()[0]
    except AnalysisException:
        return None


@dataclass
class Clock:
    """Numbers of transactions and commits, shared by states that commit together."""

    now: int = 0

    def tick(self) -> int:
        self.now += 1
        return self.now


class TxTable:
    """A keyed table under transactions: each reads what was committed when it began and its own writes, nothing of it is seen before it commits, and of two that
    write or read and write one key the later one is turned down (backward validation; commits are serial, as under strict two-phase locking).

    Committed versions are DataFrames with their commit numbers; reading takes the last version of each key.
    """

    def __init__(self, df: DataFrame, key: str, clock: Clock | None = None):
        self.columns, self.key, self.clock = df.columns, key, clock or Clock()
        self.versions: list[tuple[int, DataFrame]] = [(0, df.withColumn("_gone", F.lit(False)))]
        self.starts: dict[int, int] = {}
        self.logs: dict[int, list[DataFrame]] = {}
        self.reads: dict[int, list[Column]] = {}

    def begin(self) -> int:
        tx = self.clock.tick()
        self.starts[tx] = tx
        return tx

    def _state(self, parts: list[DataFrame]) -> DataFrame:
        out = None
        for i, part in enumerate(parts):
            p = part.select(*self.columns, "_gone").withColumn("_seq", F.lit(i))
            out = p if out is None else out.unionByName(p)
        return last_writes(out, self.key, outdated="_gone").select(*self.columns)

    def read(self, at: int | None = None) -> DataFrame:
        """As of commit at, or the last one."""
        return self._state([v for c, v in self.versions if at is None or c <= at])

    select = read

    def read_own(self, tx: int, predicate: Column | None = None) -> DataFrame:
        """What the transaction sees; with a predicate, only those keys count as read."""
        self.reads.setdefault(tx, []).append(F.lit(True) if predicate is None else predicate)
        rows = self._state([v for c, v in self.versions if c <= self.starts.get(tx, tx)] + self.logs.get(tx, []))
        return rows if predicate is None else rows.filter(predicate)

    def write(self, tx: int, rows: DataFrame) -> None:
        self.logs.setdefault(tx, []).append(rows.select(*self.columns).withColumn("_gone", F.lit(False)))

    def delete(self, tx: int, predicate: Column) -> None:
        self.logs.setdefault(tx, []).append(self._state([v for c, v in self.versions if c <= self.starts.get(tx, tx)] + self.logs.get(tx, [])).filter(predicate).withColumn("_gone", F.lit(True)))

    def abort(self, tx: int) -> None:
        for held in (self.logs, self.reads, self.starts):
            held.pop(tx, None)

    def valid(self, tx: int) -> bool:
        """Whether nothing was committed since tx began that it has read or written."""
        later = [v for c, v in self.versions if c > self.starts.get(tx, tx)]
        touched = [p.select(self.key) for p in self.logs.get(tx, [])]
        seen = self._state([v for c, v in self.versions if c <= self.starts.get(tx, tx)])
        touched += [seen.filter(p).select(self.key) for p in self.reads.get(tx, [])]
        return not any(not t.join(v.select(self.key), self.key, "left_semi").isEmpty() for v in later for t in touched)

    def publish(self, tx: int, at: int) -> None:
        """The transaction's writes, the last of each key, as one version."""
        parts = self.logs.get(tx)
        if parts:
            out = None
            for i, part in enumerate(parts):
                p = part.withColumn("_seq", F.lit(i))
                out = p if out is None else out.unionByName(p)
            self.versions.append((at, last_writes(out, self.key, outdated="").select(*self.columns, "_gone")))
        self.abort(tx)

    def commit(self, tx: int) -> int | None:
        """The number of the commit, or None if tx is turned down, and then aborted."""
        return commit_together([self], tx)


def commit_together(tables: list[TxTable], tx: int) -> int | None:
    """All states of a transaction or none; they share a clock."""
    if not all(t.valid(tx) for t in tables):
        for t in tables:
            t.abort(tx)
        return None
    at = tables[0].clock.tick()
    for t in tables:
        t.publish(tx, at)
    return at
