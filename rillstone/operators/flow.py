"""Flow: a fluent builder over a DataFrame that remembers arrival order, key, event time, partition and a pending window.

Per-arrival results are functions of the arrival order `_seq`. A sliding window is only recorded; the next aggregate turns it into a window frame, so no retractions are made
unless changelog() asks for them. Rows that a sink would drop as outdated are never produced.

Operators that count rows need an order without gaps. Sources give one; filters, unions and files do not, and what follows them numbers the rows that are left (`_pos`). Without a
key or a partition, windows are dealt in blocks of this order, each with the rows ahead that its first windows reach into, and running totals are those of a block plus the sums of the
blocks ahead: no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions.aggregates import Agg

Expr = Column | str
#: Rows of a block of an order that has no partition of its own.
BLOCK_ROWS = 16_384
#: How serialised rows write times.
BYTES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@dataclass(frozen=True)
class Pending:
    """A window that the next operator consumes: kind row or range, size in rows or seconds, tumbling or sliding, aligned to data or to the epoch."""

    kind: str
    size: float
    tumbling: bool = False
    align: str = "data"


def _col(e: Expr) -> Column:
    return F.expr(e) if isinstance(e, str) else e


@dataclass(frozen=True)
class Flow:
    df: DataFrame
    key: str | None = None
    ts: str | None = None
    tx: str | None = None
    part: str | None = None
    window: Pending | None = None
    #: Whether _seq counts from 0 without gaps (in each part).
    dense: bool = True

    # -- building -----------------------------------------------------------------------------------------------

    @staticmethod
    def of(df: DataFrame, order: Iterable[str] = (), ts: str | None = None, part: str | None = None) -> Flow:
        """order: columns of the arrival order. Without them df must have a column _seq already."""
        order = list(order)
        if order:
            df = dense_order(df, order, part)
        return Flow(df, ts=ts, part=part)

    def _with(self, df: DataFrame, **more) -> Flow:
        return replace(self, df=df, **more)

    def where(self, predicate: Expr) -> Flow:
        return self._with(self.df.filter(_col(predicate)), dense=False)

    def map(self, *columns: Expr, **named: Expr) -> Flow:
        keep = [c for c in ("_seq", "_outdated", self.part, self.ts, self.key, self.tx) if c and c in self.df.columns]
        cols = [_col(c) for c in columns] + [_col(c).alias(n) for n, c in named.items()]
        made = self.df.select(*cols).columns
        return self._with(self.df.select(*cols, *[c for c in keep if c not in made]))

    def map_rows(self, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Flow:
        """An opaque Python projection, batch by batch through Arrow."""
        return self._with(self.df.mapInPandas(lambda it: map(f, it), schema), dense=False)

    def key_by(self, key: str) -> Flow:
        return replace(self, key=key)

    def assign_timestamps(self, ts: str, unit: str = "timestamp") -> Flow:
        """unit 'seconds' turns a number of seconds into a timestamp."""
        return self._with(self.df.withColumn(ts, F.timestamp_seconds(ts)), ts=ts) if unit == "seconds" else replace(self, ts=ts)

    def assign_transaction_id(self, tx: str) -> Flow:
        return replace(self, tx=tx)

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> Flow:
        return self._with(f(self.df), dense=False)

    def notify(self, name: str, *metrics: Column) -> Flow:
        """Named metrics of what passes by, without another job."""
        return self._with(self.df.observe(name, *metrics))

    def queue(self) -> Flow:
        """Spark pipelines and decouples stages itself."""
        return self

    def barrier(self, ready: Callable[[], bool]) -> Flow:
        """Fails the build unless what the flow waits for is there: a batch plan has no threads to hold."""
        if not ready():
            raise RuntimeError("the barrier's condition does not hold")
        return self

    # -- extraction ----------------------------------------------------------------------------------------------

    def extract(self, schema: str, sep: str = ",", column: str = "value") -> Flow:
        """Fields of a line; empty or missing ones are null, surplus ones are dropped, quotes mean nothing."""
        from pyspark.sql.types import StructType

        fields = F.split(column, "\\Q" + sep + "\\E", -1)
        cols = [F.nullif(F.get(fields, F.lit(i)), F.lit("")).try_cast(f.dataType).alias(f.name) for i, f in enumerate(StructType.fromDDL(schema).fields)]
        return self._with(self.df.select(*cols, *[c for c in ("_seq", self.part) if c and c in self.df.columns]))

    def extract_json(self, schema: str, column: str = "value") -> Flow:
        """Top-level keys of an object; read as text first, so that "10" is a number where one is asked for."""
        from pyspark.sql.types import StructType

        fields = StructType.fromDDL(schema).fields
        parsed = F.from_json(column, ", ".join(f"`{f.name}` string" for f in fields))
        rest = [c for c in self.df.columns if c != column and c not in [f.name for f in fields]]
        return self._with(self.df.withColumn("_j", parsed).select(*rest, *[F.col(f"_j.{f.name}").try_cast(f.dataType).alias(f.name) for f in fields]))

    def serialize(self, column: str = "value") -> Flow:
        """Each row's columns, but for those that begin with _, as bytes of one binary column: JSON with nulls and microseconds. What is outdated is not marked."""
        own = [c for c in self.df.columns if not c.startswith("_")]
        rest = [c for c in self.df.columns if c == "_seq" or c == self.part and c.startswith("_")]
        return self._with(self.df.select(F.encode(F.to_json(F.struct(*own), BYTES | {"ignoreNullFields": "false"}), "UTF-8").alias(column), *rest))

    def deserialize(self, schema: str, column: str = "value") -> Flow:
        """The rows that serialize() packed; bytes that are no such row give nulls."""
        rest = [c for c in self.df.columns if c == "_seq" or c == self.part and c.startswith("_")]
        # Bytes that are not UTF-8 would end the query in a plain decoding.
        text = F.try_validate_utf8(F.col(column).cast("string"))
        return self._with(self.df.select(F.from_json(text, schema, BYTES).alias("_row"), *rest).select("_row.*", *rest))

    def tuplify(self, predicates: list[str], mode: str = "punctuated", s: str = "s", p: str = "p", o: str = "o", seconds: float | None = None) -> Flow:
        """Triples to wide rows; of repeated predicates the last object counts, unknown ones are dropped.

        punctuated: one row for each subject; completed: only subjects with all predicates; ordered: one for each run of a subject;
        window: a subject's row takes its triples of less than so many seconds from the row's first triple on, the next triple begins another.
        """
        by = [s]
        df = self.df
        if mode == "window":
            if self.ts is None or seconds is None:
                raise ValueError("tuplify by windows needs timestamps and seconds")
            # Subjects are independent: each is a partition of its own while its windows are found.
            df = self.df.withColumn("_own", F.to_json(F.struct(*self._parts(), s)))
            df = replace(self, df=df, part="_own").tumbling_window("range", seconds)._tumbled([]).withColumnRenamed("_win", "_run")
            by = [s, "_run"]
        if mode == "ordered":
            w = Window.partitionBy(*self._parts()).orderBy("_seq")
            df = df.withColumn("_new", (~F.col(s).eqNullSafe(F.lag(s).over(w))).cast("int")).withColumn("_run", F.sum("_new").over(w))
            by = [s, "_run"]
        df = df.filter(F.col(p).isin(predicates))
        out = df.groupBy(*self._parts(), *by).agg(F.min("_seq").alias("_seq"), *[F.max_by(F.when(F.col(p) == x, F.col(o)), F.when(F.col(p) == x, F.col("_seq"))).alias(x) for x in predicates], F.count_distinct(p).alias("_n"))
        if mode == "completed":
            out = out.filter(F.col("_n") == len(predicates))
        return self._with(out.drop("_n", "_run"), dense=False)

    def batch(self, n: int, keep_partial: bool = False) -> Flow:
        df, pos = self._placed()
        rows = [c for c in self.df.columns if c not in ("_seq", self.part)]
        elem = F.struct("_seq", *rows)
        out = df.groupBy(*self._parts(), F.floor(F.col(pos) / n).alias("_b")).agg(F.sort_array(F.collect_list(elem)).alias("batch"))
        out = out.select(*self._parts(), F.col("_b").alias("_seq"), "batch")
        return self._with(out if keep_partial else out.filter(F.size("batch") == n), dense=True)

    def unbatch(self) -> Flow:
        return self._with(self.df.select(*self._parts(), F.inline("batch")), dense=False)

    # -- partitions ----------------------------------------------------------------------------------------------

    def _parts(self) -> list[str]:
        return [self.part] if self.part else []

    def partition_by(self, f: Expr, n: int) -> Flow:
        """Rows with ids outside 0 to n - 1 are dropped; later state is kept for each partition by itself."""
        if self.part:
            raise ValueError("the flow is partitioned already")
        df = self.df.withColumn("_part", _col(f)).filter(F.col("_part").between(0, n - 1))
        return self._with(dense_order(df, ["_seq"], "_part") if "_seq" in df.columns else df, part="_part", dense=True)

    def merge(self) -> Flow:
        return self._with(self.df.drop(self.part) if self.part else self.df, part=None, dense=False)

    # -- order ---------------------------------------------------------------------------------------------------

    def _placed(self) -> tuple[DataFrame, str]:
        """The rows, and the column that counts them in order without gaps: _seq, or _pos where filters, unions or files have left gaps."""
        if self.dense:
            return self.df, "_seq"
        if self.part:
            return self.df.withColumn("_pos", (F.row_number().over(Window.partitionBy(self.part).orderBy("_seq")) - 1).cast("long")), "_pos"
        return dense_order(self.df.withColumn("_own", F.col("_seq")), ["_own"]).withColumnsRenamed({"_seq": "_pos", "_own": "_seq"}), "_pos"

    # -- windows -------------------------------------------------------------------------------------------------

    def sliding_window(self, kind: str, size: float) -> Flow:
        return replace(self, window=Pending(kind, size))

    def tumbling_window(self, kind: str, size: float, align: str = "data") -> Flow:
        """align 'data' opens a range window with the row that closes the one before; 'epoch' cuts time at multiples of size, with one shuffle."""
        return replace(self, window=Pending(kind, size, True, align))

    def _micros(self) -> Column:
        return F.unix_micros(F.col(self.ts).cast("timestamp"))

    def _tumbled(self, keys: list[str]) -> DataFrame:
        """With the number of each row's window in _win."""
        w = self.window
        if w.kind == "row":
            df, pos = self._placed()
            return df.withColumn("_win", F.floor(F.col(pos) / int(w.size)))
        if w.align == "epoch":
            return self.df.withColumn("_win", F.floor(self._micros() / int(w.size * 1_000_000)))
        size, parts = int(w.size * 1_000_000), self._parts()
        df = self.df.withColumn("_us", self._micros()).withColumn("_all", F.lit(0))

        def anchor(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_seq")
            out, n, opened = [], 0, None
            for us in pdf["_us"]:
                if opened is None:
                    opened = us
                elif opened <= us - size:
                    opened, n = us, n + 1
                out.append(n)
            return pd.DataFrame({**{p: pdf[p] for p in parts}, "_seq": pdf["_seq"], "_win": out})

        # Only order and time travel to Python; each next window depends on the one before, so the parallelism is that of the partitions.
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*parts, "_seq").schema.fields) + ", _win long"
        ids = df.select("_all", *parts, "_seq", "_us").groupBy("_all", *parts).applyInPandas(anchor, ddl)
        return self.df.join(ids, [*parts, "_seq"])

    def _frame(self, keys: list[str]):
        """The DataFrame to aggregate over and the frame of the pending window. Rows with _halo only fill windows of others."""
        w, parts = self.window, self._parts()
        if w is None:
            return self.df, Window.partitionBy(*parts, *keys).orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
        if w.tumbling:
            return self._tumbled(keys), Window.partitionBy(*parts, "_win", *keys).orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
        if w.kind == "row":
            # The buffer is one for all keys: a range over the dense order is right for every key.
            df, pos = self._placed()
            n = int(w.size)
            by = [*parts, *keys]
            if not parts:
                df, by = _blocked(df, F.col(pos), max(BLOCK_ROWS, 4 * n), n - 1), ["_blk", *keys]
            return df, Window.partitionBy(*by).orderBy(pos).rangeBetween(-(n - 1), 0)
        size = int(w.size * 1_000_000)
        df, by = self.df.withColumn("_us", self._micros()), [*parts, *keys]
        if not by:
            df, by = _blocked(df, F.col("_us"), 4 * size, size - 1), ["_blk"]
        # Of rows with one time only those that came first are in the window. They get places behind their time, fewer than half a step, so that one distance holds for all.
        tie = F.row_number().over(Window.partitionBy(*by, "_us").orderBy("_seq"))
        # (Frames take distances up to 2^63: at a day so many as 2^24 rows of one key and microsecond have a place, at ten years 4,096.)
        step = 1 << min(32, 62 - size.bit_length())
        df = df.withColumn("_key", F.col("_us").cast("decimal(38,0)") * step + tie)
        return df, Window.partitionBy(*by).orderBy("_key").rangeBetween(-((size - 1) * step + step // 2), 0)

    def _emitted(self, df: DataFrame, keys: list[str], aggs: tuple[Agg, ...], frame, every: int | None, seconds: float | None) -> Flow:
        """The rows with their aggregates; the columns of a row stay beside them."""
        names = {a.name for a in aggs}
        keep = [c for c in self.df.columns if c not in names] + [c for c in ("_win", "_halo", "_pos") if c in df.columns and c not in self.df.columns]
        out = df.select(*keep, *[a.over(frame) for a in aggs])
        out = out.filter("not _halo").drop("_halo") if "_halo" in out.columns else out
        if every:
            flow = replace(self, df=out) if self.dense else replace(self, df=out.drop("_pos"))
            out, pos = (out, "_pos") if "_pos" in out.columns else flow._placed()
            out = out.filter((F.col(pos) + 1) % every == 0)
        out = out.drop("_pos")
        if seconds:
            out = self._triggered(out, int(seconds * 1_000_000))
        return replace(self, df=out, window=None, dense=self.dense and not every and not seconds)

    def _totalled(self, aggs: tuple[Agg, ...], every: int | None, seconds: float | None) -> Flow:
        """Running totals over one order: within blocks, with the totals of the blocks ahead."""
        df, pos = self._placed()
        df = df.withColumn("_blk", F.floor(F.col(pos) / BLOCK_ROWS))
        frame = Window.partitionBy("_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        totals = df.groupBy("_blk").agg(*[p.total().alias(p.name) for a in aggs for p in a.parts()])
        # One row for each block of BLOCK_ROWS rows.
        ahead = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("_blk", *[p.merged().over(ahead).alias("_a" + p.name) for a in aggs for p in a.parts()])
        names = {a.name for a in aggs}
        keep = [c for c in self.df.columns if c not in names]
        out = df.select("_blk", *dict.fromkeys([*keep, pos]), *[p.over(frame).alias("_o" + p.name) for a in aggs for p in a.parts()]).join(totals, "_blk")
        out = out.select(*dict.fromkeys([*keep, pos]), *[a.joined("_a", "_o").alias(a.name) for a in aggs])
        if every:
            out = out.filter((F.col(pos) + 1) % every == 0)
        out = out.drop("_pos")
        if seconds:
            out = self._triggered(out, int(seconds * 1_000_000))
        return replace(self, df=out, window=None, dense=self.dense and not every and not seconds)

    def _triggered(self, df: DataFrame, gap: int) -> DataFrame:
        """Rows at least gap microseconds after the row kept before; the first is held against time 0.

        Each kept row depends on the one before, so the parallelism is that of the partitions. Only order and time travel to Python, and in a partitioned
        flow only of rows later than all before them, as no other row can be kept.
        """
        parts = self._parts()
        over = Window.partitionBy(*parts).orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
        us = df.withColumn("_us", self._micros())
        rising = (us.withColumn("_max", F.max("_us").over(over)).filter("_max is null or _us > _max") if parts else us).filter("_us is not null")

        def keep(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_seq")
            last, kept = 0, []
            for t in pdf["_us"].tolist():
                on = t - last >= gap
                last = t if on else last
                kept.append(on)
            return pdf.loc[kept, [*parts, "_seq"]]

        narrow = rising.select(F.lit(0).alias("_all"), *parts, "_seq", "_us")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.select(*parts, "_seq").schema.fields)
        return df.join(narrow.groupBy("_all", *parts).applyInPandas(keep, ddl), [*parts, "_seq"])

    def fold(self, name: str, column: Expr, f: Callable[[Column], Column]) -> Flow:
        """A window function of one's own: f turns the array of column over the pending window, in arrival order, into a value for each arrival."""
        df, frame = self._frame([])
        rows = F.sort_array(F.collect_list(F.struct(F.col("_seq").alias("s"), _col(column).alias("x"))).over(frame))
        out = df.withColumn(name, f(F.transform(rows, lambda r: r["x"])))
        out = out.filter("not _halo") if "_halo" in out.columns else out
        return replace(self, df=out.drop("_us", "_win", "_key", "_halo", "_blk", "_pos"), window=None)

    def aggregate(self, *aggs: Agg, emit: str = "each", every: int | None = None, seconds: float | None = None) -> Flow:
        """emit 'each': the aggregate at every arrival (or every n-th one); 'final': the totals, with partial aggregation and no order."""
        if emit == "final":
            df = self._tumbled([]) if self.window and self.window.tumbling else self.df
            by = self._parts() + (["_win"] if "_win" in df.columns else [])
            return replace(self, df=df.groupBy(*by).agg(*[a.total() for a in aggs]), window=None)
        if self.window is None and not self.part and all(a.parts() for a in aggs):
            return self._totalled(aggs, every, seconds)
        df, frame = self._frame([])
        return self._emitted(df, [], aggs, frame, every, seconds)

    def group_by(self, *aggs: Agg, emit: str = "each", every: int | None = None, seconds: float | None = None) -> Flow:
        if self.key is None:
            raise ValueError("group_by needs key_by ahead")
        if emit == "final":
            df = self._tumbled([self.key]) if self.window and self.window.tumbling else self.df
            by = [*self._parts(), self.key] + (["_win"] if "_win" in df.columns else [])
            return replace(self, df=df.groupBy(*by).agg(*[a.total() for a in aggs]), window=None)
        df, frame = self._frame([self.key])
        return self._emitted(df, [self.key], aggs, frame, every, seconds)

    def changelog(self) -> Flow:
        """Inserts and, where the pending window lets rows go, retractions: columns _at (arrival that causes it) and _outdated."""
        w, parts = self.window, self._parts()
        if w is None:
            df = self.df.withColumn("_gone", F.lit(None).cast("long"))
        elif w.kind == "row" and not w.tumbling:
            # A row goes when the one that many places behind comes.
            df, pos = self._placed()
            later = df.select(*parts, (F.col(pos) - int(w.size)).alias(pos), F.col("_seq").alias("_gone"))
            df = df.join(later, [*parts, pos], "left")
        elif not w.tumbling:
            # The first arrival at least so much later; from the end, so that frames only grow.
            df = self.df.withColumn("_us", self._micros())
            df = df.withColumn("_gone", F.min("_seq").over(Window.partitionBy(*parts).orderBy(-F.col("_us")).rangeBetween(Window.unboundedPreceding, -int(w.size * 1_000_000))))
        else:
            df = self._tumbled([])
            first = df.groupBy(*parts, "_win").agg(F.min("_seq").alias("_gone")).withColumn("_win", F.col("_win"))
            order = Window.partitionBy(*parts).orderBy("_win")
            first = first.select(*parts, "_win", F.lead("_gone").over(order).alias("_gone"))  # one row for each window
            df = df.join(first, [*parts, "_win"], "left")
        live = F.struct(F.col("_seq").alias("_at"), F.lit(False).alias("_outdated"))
        dead = F.struct(F.col("_gone").alias("_at"), F.lit(True).alias("_outdated"))
        both = F.when(F.col("_gone").isNull(), F.array(live)).otherwise(F.array(live, dead))
        return replace(self, df=df.drop("_us", "_win", "_pos").select("*", F.inline(both)), window=None, dense=False)

    def aggregate_changes(self, *aggs: Agg) -> Flow:
        """Behind changelog(): the aggregates after every change, those of the key where there is one; what goes at an arrival goes before it comes.

        For sums, counts and averages, which can be taken back; an average of nothing is null. Columns _at and _outdated stay.
        """
        if not {"_at", "_outdated"} <= set(self.df.columns):
            raise ValueError("aggregate_changes needs changelog() ahead")
        wrong = [a.kind for a in aggs if a.kind not in ("sum", "count", "avg", "int_avg")]
        if wrong:
            raise ValueError(f"cannot be taken back: {', '.join(wrong)}")
        sign = F.when(F.col("_outdated"), -1).otherwise(1)
        signed, sums, out = {"_rank": (~F.col("_outdated")).cast("int"), "_s": sign}, [Agg("sum", "_s", "_n")], []
        for i, a in enumerate(aggs):
            if a.kind != "count":
                signed |= {f"_x{i}": F.coalesce(F.col(a.column), F.lit(0)) * sign, f"_v{i}": F.when(F.col(a.column).isNotNull(), sign).otherwise(0)}
                sums += [Agg("sum", f"_x{i}", f"_t{i}"), Agg("sum", f"_v{i}", f"_c{i}")]
            total, n = F.col(f"_t{i}"), F.col(f"_c{i}")
            match a.kind:
                case "count":
                    out.append(F.col("_n").alias(a.name))
                case "sum":
                    out.append(F.when(n > 0, total).alias(a.name))
                case "avg":
                    out.append(F.when(n > 0, total / n).alias(a.name))
                case _:
                    out.append(F.when(F.col("_n") > 0, total / F.col("_n")).cast("long").alias(a.name))
        keep = [c for c in self.df.columns if c not in {a.name for a in aggs} | {"_seq"}]
        df = self.df.withColumns(signed).withColumn("_first", F.col("_seq"))
        flow = replace(self, df=dense_order(df.drop("_seq"), ["_at", "_rank", "_first"], self.part), dense=True)
        flow = flow.group_by(*sums) if self.key else flow.aggregate(*sums)
        return replace(flow, df=flow.df.select(*keep, "_seq", *out))

    def stateful_map(self, f: Callable, initial: Callable[[], object], schema: str) -> Flow:
        """f(row, state) -> (new row or None, state), in arrival order, one state for each partition (and key, if there is one)."""
        by = [*self._parts(), *([self.key] if self.key else [])]
        df = self.df if by else self.df.withColumn("_all", F.lit(0))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            state, out = initial(), []
            for row in pdf.sort_values("_seq").to_dict("records"):
                new, state = f(row, state)
                if new is not None:
                    out.append(new)
            return pd.DataFrame(out)

        return self._with(df.groupBy(*(by or ["_all"])).applyInPandas(run, schema), dense=False)

    # -- joins ---------------------------------------------------------------------------------------------------

    def join(self, other: Flow, predicate: Expr | None = None, prefix: tuple[str, str] = ("l_", "r_"), changes: bool = False) -> Flow:
        """Equality of both keys (and of the parts, where both sides have them) and the predicate over l_ and r_ columns. With a pending window on either side pairs must live at the same
        time. changes: pairs that end, as one of theirs leaves its window, come again with _outdated, _at the arrival that ends them."""
        windowed = bool(self.window or other.window)
        left, right = self._sided(prefix[0], windowed), other._sided(prefix[1], windowed)
        on = F.col(f"{prefix[0]}{self.key}") == F.col(f"{prefix[1]}{other.key}")
        both = bool(self.part and other.part)
        if both:
            on = on & (F.col(f"{prefix[0]}{self.part}") == F.col(f"{prefix[1]}{other.part}"))
        if windowed:
            live = lambda a, b: F.col(f"{b}_gone").isNull() | (F.col(f"{a}_seq") < F.col(f"{b}_gone"))
            on = on & live(*prefix) & live(*prefix[::-1])
        if predicate is not None:
            on = on & _col(predicate)
        df = left.join(right, on, "inner")
        if f"{prefix[0]}_seq" in df.columns and f"{prefix[1]}_seq" in df.columns:
            df = df.withColumn("_seq", F.greatest(f"{prefix[0]}_seq", f"{prefix[1]}_seq"))
        if changes:
            gone = F.least(f"{prefix[0]}_gone", f"{prefix[1]}_gone") if windowed else F.lit(None).cast("long")
            dead = df.withColumn("_at", gone).filter("_at is not null").withColumn("_outdated", F.lit(True))
            df = df.withColumn("_at", F.col("_seq")).withColumn("_outdated", F.lit(False)).unionByName(dead)
        return Flow(df.drop(f"{prefix[0]}_gone", f"{prefix[1]}_gone"), key=f"{prefix[0]}{self.key}", part=f"{prefix[0]}{self.part}" if both else None, dense=False)

    def _sided(self, prefix: str, windowed: bool) -> DataFrame:
        df = self.df
        if self.window:
            # Each row with the arrival that ends it, both sides on one arrival order.
            df = self.changelog().df.filter("not _outdated").drop("_at", "_outdated")
        elif windowed:
            df = df.withColumn("_gone", F.lit(None).cast("long"))
        return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])

    def scale_join(self, other: Flow, predicate: Expr | None = None, instances: int = 8) -> Flow:
        """The same pairs; the left side is dealt by key to so many partitions, and skewed ones are split at run time."""
        return self._with(self.df.repartition(instances, self.key)).join(other, predicate)

    def union(self, *others: Flow) -> Flow:
        """Rows of all flows; of rows with one number those of the earlier flow come first."""
        n = len(others) + 1
        dfs = [f.df.withColumn("_seq", F.col("_seq") * n + i) if "_seq" in f.df.columns else f.df for i, f in enumerate((self, *others))]
        df = dfs[0]
        for d in dfs[1:]:
            df = df.unionByName(d, allowMissingColumns=True)
        return self._with(df, dense=False)

    # -- complex events, sinks -----------------------------------------------------------------------------------

    def matcher(self, pattern, partition: str | None = None, strategy: str = "first", output: str = "one_by_one") -> Flow:
        from rillstone.operators.cep import match

        return self._with(match(self.df, pattern, [*self._parts(), *([partition] if partition else [])], strategy, output))

    def match_by_nfa(self, nfa, partition: str | None = None) -> Flow:
        """First matches of an automaton (cep.Nfa), or of a pattern, one row for each event."""
        return self.matcher(nfa, partition)

    def to_table(self, table) -> Flow:
        """Each row is inserted into a keyed table, or deletes its key if it is outdated, in order; the rows go on."""
        table.fold(self.df)
        return self

    def update_table(self, table, update: Callable, insert: Callable | None = None) -> Flow:
        """update(row, record) -> record, or None to delete it; insert(row) -> record or None, where the key has none. In order of arrival, key by key; the rows go on."""
        table.update_each(self.df, self.key or table.key, update, insert)
        return self

    def print(self, n: int = 20) -> Flow:
        self.current().df.show(n, truncate=False)
        return self

    def current(self) -> Flow:
        return self._with(self.df.filter("not _outdated").drop("_outdated")) if "_outdated" in self.df.columns else self

    def save_to_file(self, path: str, sep: str = ",") -> Flow:
        df = self.current().df
        cols = [c for c in df.columns if not c.startswith("_")]
        df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("value")).write.mode("overwrite").text(path)
        return self

    def send_zmq(self, path: str, type: str = "pub", binary: bool = False) -> Flow:
        return self.send("rillstone.sources.network:Zmq", binary=binary, path=path, type=type)

    def send(self, client: str, binary: bool = False, **options) -> Flow:
        """Rows that are not outdated to a queue: comma-separated text, or serialised."""
        from rillstone.sources import network

        flow = self.current()
        cols = [c for c in flow.df.columns if not c.startswith("_")]
        text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("value")
        network.send(flow.serialize().df.select("value") if binary else flow.df.select(text), client, **options)
        return self

    def to_stream(self, context, name: str) -> Flow:
        context.publish(name, self)
        return self

    # -- other names ---------------------------------------------------------------------------------------------

    groupby_key = group_by
    pfprint = print
    toStream, saveToFile, keyBy, assignTimestamps, assignTransactionID = to_stream, save_to_file, key_by, assign_timestamps, assign_transaction_id
    slidingWindow, tumblingWindow, groupBy, partitionBy, statefulMap, scaleJoin = sliding_window, tumbling_window, group_by, partition_by, stateful_map, scale_join
    extractJson, matchByNFA, sendZMQ = extract_json, match_by_nfa, send_zmq


def _blocked(df: DataFrame, place: Column, width: int, reach: int) -> DataFrame:
    """Blocks (_blk) of so wide a stretch of place; what lies within reach of the next block is in it too, with _halo."""
    block = F.floor(place / width).cast("long")
    own = F.struct(block.alias("_blk"), F.lit(False).alias("_halo"))
    next_ = F.struct((block + 1).alias("_blk"), F.lit(True).alias("_halo"))
    both = F.when(F.pmod(place, F.lit(width)) >= width - reach, F.array(own, next_)).otherwise(F.array(own))
    return df.select("*", F.inline(both))


def dense_order(df: DataFrame, order: list[str], part: str | None = None) -> DataFrame:
    """With _seq, 0 to n - 1 in the given order (for each part); rows that are equal in it are told apart by a hash of the whole row.

    Rows are range-partitioned, sorted and written down, partitions are counted, and each adds the counts ahead of it: a distributed row number. With a part, a plain
    window does, as parts are independent.
    """
    df = df.drop("_seq") if "_seq" in df.columns and "_seq" not in order else df
    if part:
        return df.withColumn("_seq", (F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1).cast("long"))
    from rillstone.sources.context import checkpointed

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order, F.xxhash64(*df.columns))
    ranged = checkpointed(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    block = F.shiftright("_mid", 33)
    ahead = ranged.groupBy(block.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    ahead = ahead.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n") - F.col("_first")).alias("_shift"))  # one row for each partition
    return ranged.withColumn("_b", block).join(F.broadcast(ahead), "_b").withColumn("_seq", F.col("_mid") + F.col("_shift")).drop("_b", "_mid", "_shift")
