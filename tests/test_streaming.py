"""The streaming drivers against the same result in batch; the events arrive in several micro-batches."""

import pytest
from pyspark.sql import functions as F

from rillstone.functions import aggregates as A
from rillstone.operators.cep import state
from rillstone.operators.flow import Flow
from rillstone.streaming import drivers

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """Events in three files, in order of time, read one file a batch."""
    base = tmp_path_factory.mktemp("events")
    df = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.dayofmonth("ts")
    for i, (lo, hi) in enumerate([(0, 10), (11, 20), (21, 31)]):
        df.filter(day.between(lo, hi)).coalesce(1).write.parquet(f"{base}/part{i}")

    def source():
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(base))

    return df, source


def ran(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_tumbling(spark, split, tmp_path):
    df, source = split
    shape = lambda d: drivers.tumbling(d, "ts", 86400, [A.sum_("value", "s"), A.count(name="n")], ["event_type"]).select(F.col("window.start").alias("t"), "event_type", F.round("s", 6), "n")
    assert rows(ran(shape(drivers.with_event_time(source(), "ts")), tmp_path, "tumbled", "complete")) == rows(shape(df))


def test_windowed_join(spark, split, tmp_path):
    df, source = split
    side = lambda d, p: d.select(*[F.col(c).alias(p + c) for c in ("event_id", "user_id", "ts")])
    join = lambda a, b: drivers.windowed_join(a.withColumnRenamed("l_user_id", "u"), b.withColumnRenamed("r_user_id", "u"), "u", "l_ts", "r_ts", 3600).select("l_event_id", "r_event_id")
    late = "40 days"
    got = ran(join(drivers.with_event_time(side(source(), "l_"), "l_ts", late), drivers.with_event_time(side(source(), "r_"), "r_ts", late)), tmp_path, "joined")
    assert rows(got) == rows(join(side(df, "l_"), side(df, "r_")))


def test_stateful_map(spark, split, tmp_path):
    df, source = split
    step = lambda r, s: ({"event_id": r["event_id"], "n": s + 1}, s + 1)
    got = ran(drivers.stateful_map(source(), ["user_id"], "event_id", step, int, "event_id long, n long"), tmp_path, "stated")
    per_user = {}
    for r in ran(source().select("user_id", "event_id"), tmp_path, "plain").collect():
        per_user.setdefault(r.user_id, []).append(r.event_id)
    assert rows(got.select("n")) == sorted((i + 1,) for ids in per_user.values() for i in range(len(ids)))


def test_matches_go_on_over_batches(spark, split, tmp_path):
    df, source = split
    first, second = sorted(r[0] for r in df.select("event_type").distinct().collect())[:2]
    pattern = state(lambda e: e["event_type"] == first) >> state(lambda e: e["event_type"] == second)
    cols = ["user_id", "ts", "event_id", "event_type"]
    got = ran(drivers.matches(source().select(*cols), pattern, ["user_id"], "ts"), tmp_path, "matched")
    want = Flow.of(df.select(*cols), ["ts", "event_id"], part="user_id").matcher(pattern)
    assert rows(got.select("event_id", "_match", "_pos")) == rows(want.df.select("event_id", "_match", "_pos"))


def test_upsert(spark, split, tmp_path):
    df, source = split
    seen = []
    drivers.upsert_into(source(), lambda b, i: seen.append((i, b.count())), str(tmp_path / "c")).awaitTermination(120)
    assert len(seen) == 3 and sum(n for _, n in seen) == df.count()
