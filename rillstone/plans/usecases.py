"""Use cases: road tolls, anomalies by clusters and transitions, frequent contiguous patterns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_speed(positions: DataFrame, minutes: int = 5) -> DataFrame:
    """positions (vid, m, seg, speed) -> seg, m, n (cars), lav: the mean of the cars' means over the last minutes.

    The means are summed as decimals of nine digits, so that reruns agree whatever the order of the shuffle.
    """
    cars = positions.groupBy("seg", "m", "vid").agg(F.avg("speed").cast("decimal(28, 9)").alias("s"))
    a = cars.groupBy("seg", "m").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("seg").orderBy("m").rangeBetween(-(minutes - 1), 0)
    return a.select("seg", "m", "n", (F.sum("s").over(w).cast("double") / F.sum("n").over(w)).alias("lav"))


def tolls(positions: DataFrame, speed_below: float = 40, cars_above: int = 50, accident: DataFrame | None = None) -> DataFrame:
    """Slow and full minutes of a segment are charged, unless an accident (dir, seg, m) lies ahead: in it or the next four segments of its direction, in the minute before. Positions and
    accidents without a direction are of one."""
    a = average_speed(positions)
    due = (F.col("lav") < speed_below) & (F.col("n") > cars_above)
    if accident is not None:
        # Each accident is told to the few segments behind it, so that segments are joined by equality.
        behind = F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda x: F.col("seg") - x))
        told = accident.select(behind.alias("seg"), (F.col("m") + 1).alias("m")).distinct().withColumn("hit", F.lit(True))
        a = a.join(told, ["seg", "m"], "left")
        due = due & F.col("hit").isNull()
    return a.withColumn("toll", F.when(due, 2.0 * F.pow(F.col("n") - cars_above, 2)).otherwise(0.0)).drop("hit")


def accidents(positions: DataFrame, reports: int = 4, cars: int = 2) -> DataFrame:
    """positions (vid, time, m, seg, pos): seg, m of minutes in which so many cars stood at one place, each for so many reports in a row."""
    w = Window.partitionBy("vid").orderBy("time").rowsBetween(-(reports - 1), 0)
    place = F.struct("seg", "pos")
    stopped = positions.withColumn("same", (F.min(place).over(w) == F.max(place).over(w)) & (F.count(F.lit(1)).over(w) == reports)).filter("same")
    return stopped.groupBy("seg", "pos", "m").agg(F.count_distinct("vid").alias("n")).filter(F.col("n") >= cars).select("seg", "m").distinct()


def transition_anomalies(df: DataFrame, by: list[str], k: int = 5, window: int = 10, chain: int = 5, threshold: float = 0.005) -> DataFrame:
    """df (by, _seq, value): rows whose last transitions between value clusters of the window are improbable. Groups are independent."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by, "_seq").schema.fields) + ", probability double"

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq").reset_index(drop=True)
        out = []
        for end in range(window, len(pdf) + 1):
            x = pdf["value"].to_numpy()[end - window : end]
            c = np.asarray(list(dict.fromkeys(x))[:k], float)
            for _ in range(50):
                own = np.abs(x[:, None] - c[None, :]).argmin(1)
                new = np.asarray([x[own == i].mean() if (own == i).any() else c[i] for i in range(len(c))])
                if np.allclose(new, c):
                    break
                c = new
            own = np.abs(x[:, None] - c[None, :]).argmin(1)
            steps = list(zip(own[:-1], own[1:], strict=True))
            p = 1.0
            for a, b in steps[-chain:]:
                p *= steps.count((a, b)) / sum(s == a for s, _ in steps)
            if p < threshold:
                out.append({**{n: pdf[n].iloc[end - 1] for n in by}, "_seq": pdf["_seq"].iloc[end - 1], "probability": p})
        return pd.DataFrame(out, columns=[*by, "_seq", "probability"])

    return df.select(*by, "_seq", "value").groupBy(*by).applyInPandas(find, ddl)


def frequent_patterns(sequences: DataFrame, column: str = "items", least: int = 2, maximal: bool = False) -> DataFrame:
    """Contiguous sub-sequences, of any length, that stand in at least so many sequences, with their support; maximal: without those that a longer one with the same support holds.

    Patterns grow by an item a round: only places where a frequent pattern stands are looked at again, until none is left.
    """
    from rillstone.sources.context import checkpointed

    rows = checkpointed(sequences.filter(F.size(column) > 0).select(F.monotonically_increasing_id().alias("sid"), F.col(column).alias("items")))
    places = rows.select("sid", F.posexplode(F.transform("items", lambda x: F.array(x))).alias("at", "pattern"))
    out, n = None, 1
    while True:
        found = checkpointed(places.groupBy("pattern").agg(F.count_distinct("sid").alias("support")).filter(F.col("support") >= least))
        if out is not None and found.isEmpty():
            break
        out = found if out is None else out.unionByName(found)
        n += 1
        own = places.join(found.select("pattern"), "pattern", "left_semi").select("sid", "at")
        places = checkpointed(own.join(rows, "sid").filter(F.size("items") >= F.col("at") + n).select("sid", "at", F.slice("items", F.col("at") + 1, n).alias("pattern")))
    if maximal:
        size = F.size("pattern")
        longer = out.filter(size > 1)
        parts = longer.select(F.slice("pattern", F.lit(1), size - 1).alias("pattern"), "support").unionByName(longer.select(F.slice("pattern", F.lit(2), size - 1).alias("pattern"), "support")).distinct()
        out = out.join(parts, ["pattern", "support"], "left_anti")
    return out


def user_transitions(df: DataFrame, k: int = 3) -> DataFrame:
    """Anomalous rows of each user's stream of values, as transition_anomalies finds them with few clusters."""
    return transition_anomalies(df, ["user_id"], k=k, window=10, chain=5, threshold=0.02)
