"""The same operators over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.serializers import CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.functions.aggregates import Agg
from rillstone.operators.cep import Pattern, run_matches

_STATE = "state binary"
_pickle = CPickleSerializer()


def with_event_time(df: DataFrame, ts: str, late: str = "10 minutes") -> DataFrame:
    """Watermarks need TIMESTAMP; parquet may hold TIMESTAMP_NTZ."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, ts: str, seconds: int, aggs: list[Agg], by: list[str] | None = None, slide: int | None = None) -> DataFrame:
    w = F.window(ts, f"{seconds} seconds", f"{slide or seconds} seconds")
    return df.groupBy(w, *(by or [])).agg(*[a.total(ts) for a in aggs])


def windowed_join(left: DataFrame, right: DataFrame, key: str, lts: str, rts: str, seconds: int) -> DataFrame:
    """Pairs of equal key at most so many seconds apart; both sides need watermarks."""
    span = F.expr(f"INTERVAL {seconds} SECONDS")
    return left.join(right, (left[key] == right[key]) & (right[rts] >= left[lts] - span) & (right[rts] <= left[lts] + span))


def _with_state(df: DataFrame, by: list[str], order: str, schema: str, initial: Callable[[], object], step: Callable) -> DataFrame:
    """step(rows in order, state) -> (rows out, state), for each key and micro-batch; the state is kept from batch to batch."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def run(key, pdfs, held):
        state = _pickle.loads(bytes(held.get[0])) if held.exists else initial()
        rows = pd.concat(list(pdfs)).sort_values(order, kind="stable").to_dict("records")
        out, state = step(rows, state)
        held.update((_pickle.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(*by).applyInPandasWithState(run, schema, _STATE, "append", "NoTimeout")


def stateful_map(df: DataFrame, by: list[str], order: str, f: Callable, initial: Callable[[], object], schema: str) -> DataFrame:
    """f(row, state) -> (new row or None, state) for each key, in the order of a column within each micro-batch."""

    def step(rows: list[dict], state):
        out = []
        for row in rows:
            new, state = f(row, state)
            if new is not None:
                out.append(new)
        return out, state

    return _with_state(df, by, order, schema, initial, step)


def matches(df: DataFrame, pattern: Pattern, by: list[str], order: str, strategy: str = "first") -> DataFrame:
    """Events of matches, with _match (number within the key) and _pos; runs stay open from batch to batch."""
    names = df.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _match long, _pos long"

    def step(rows: list[dict], state: tuple):
        done, runs = state
        found = run_matches(rows, pattern, strategy, runs)
        out = [{**{n: e[n] for n in names}, "_match": done + i, "_pos": j} for i, m in enumerate(found) for j, e in enumerate(m)]
        return out, (done + len(found), runs)

    return _with_state(df, by, order, ddl, lambda: (0, []), step)


def upsert_into(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Every micro-batch is given to merge with its id; available data only."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
