"""Aggregate functions, each with a form for grouped totals and one for frames (running totals and windows)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Agg:
    """kind of column, named name. seq orders what is recent; cast makes integer averages."""

    kind: str
    column: str | None
    name: str
    by: str | None = None
    #: Kind custom: from a column to an aggregate of it, such as a grouped-aggregate Pandas UDF.
    make: Callable[[Column], Column] | None = None

    def total(self, seq: str = "_seq") -> Column:
        return self._make(lambda c: c, False, seq).alias(self.name)

    def over(self, w: WindowSpec, seq: str = "_seq") -> Column:
        return self._make(lambda c: c.over(w), True, seq).alias(self.name)

    def parts(self) -> list[Agg]:
        """Aggregates that, merged over blocks of rows, make up this one; none if it cannot be taken apart."""
        n = lambda kind, i: Agg(kind, self.column, f"{self.name}_{i}", self.by)
        match self.kind:
            case "sum" | "count" | "min" | "max" | "global_min" | "global_max":
                return [n(self.kind, 0)]
            case "avg":
                return [n("sum", 0), n("values", 1)]
            case "int_avg":
                return [n("sum", 0), n("count", 1)]
            case "least_recent" if not self.by:
                return [n("least_recent", 0), n("count", 1)]
            case "most_recent" | "identity" if not self.by:
                return [n("most_recent", 0)]
        return []

    def merged(self) -> Column:
        """The aggregate, over one row of it for each block in order."""
        x = F.col(self.name)
        match self.kind:
            case "min" | "global_min":
                return F.min(x)
            case "max" | "global_max":
                return F.max(x)
            case "least_recent":
                return F.first(x)
            case "most_recent":
                return F.last(x)
        return F.sum(x)

    def joined(self, ahead: str, own: str) -> Column:
        """This aggregate of its parts: those of the blocks ahead (null in the first), and those of the own block so far."""
        a, o = ([F.col(f"{x}{p.name}") for p in self.parts()] for x in (ahead, own))
        plus = lambda i: F.when(a[i].isNull(), o[i]).when(o[i].isNull(), a[i]).otherwise(a[i] + o[i])
        match self.kind:
            case "min" | "global_min":
                return F.least(a[0], o[0])
            case "max" | "global_max":
                return F.greatest(a[0], o[0])
            case "avg":
                return F.try_divide(plus(0), plus(1))
            case "int_avg":
                return (plus(0) / plus(1)).cast("long")
            case "least_recent":
                return F.when(a[1].isNull(), o[0]).otherwise(a[0])
            case "most_recent" | "identity":
                return o[0]
        return plus(0)

    def _make(self, o, framed: bool, seq: str) -> Column:
        x = F.col(self.column) if self.column else F.lit(1)
        recent = self.by or seq
        match self.kind:
            case "sum":
                return o(F.sum(x))
            case "count":
                return o(F.count(F.lit(1)))
            case "values":
                return o(F.count(x))
            case "avg":
                return o(F.avg(x))
            case "int_avg":
                return (o(F.sum(x)) / o(F.count(F.lit(1)))).cast("long")
            case "dcount":
                return F.size(o(F.collect_set(x))).cast("long") if framed else F.count_distinct(x)
            case "min" | "global_min":
                return o(F.min(x))
            case "max" | "global_max":
                return o(F.max(x))
            case "least_recent":
                return o(F.min_by(x, F.col(recent)))
            case "most_recent" | "identity":
                return o(F.max_by(x, F.col(recent)))
            case "custom":
                return o(self.make(x))
            case "median":
                return o(F.percentile(x, F.lit(0.5)))
        raise ValueError(f"no aggregate is called {self.kind}")


def _maker(kind: str):
    def make(column: str | None = None, name: str | None = None, by: str | None = None) -> Agg:
        return Agg(kind, column, name or f"{kind}_{column or 'rows'}", by)

    return make


sum_, count, avg, int_avg, dcount, min_, max_ = map(_maker, ("sum", "count", "avg", "int_avg", "dcount", "min", "max"))
global_min, global_max, least_recent, most_recent, median, identity = map(_maker, ("global_min", "global_max", "least_recent", "most_recent", "median", "identity"))


def custom(make: Callable[[Column], Column], column: str, name: str) -> Agg:
    """An aggregate of one's own; in frames it must be one that Spark takes over a window."""
    return Agg("custom", column, name, make=make)


#: Aggregates by the names of the typed interface: the type of a column is Spark's own.
TYPED = {
    "Int": identity, "String": identity, "Double": identity, "IntSum": sum_, "DoubleSum": sum_, "IntAvg": int_avg, "DoubleAvg": avg, "Count": count, "DistinctCount": dcount,
    "IntMin": min_, "DoubleMin": min_, "StringMin": min_, "IntMax": max_, "DoubleMax": max_, "StringMax": max_,
}
