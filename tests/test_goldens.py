"""Known small results: extraction, windows, triggers, joins, patterns, matrices."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rillstone.functions import aggregates as A
from rillstone.functions.scalar import parse_timestamp
from rillstone.operators import matrices
from rillstone.operators.cep import run_matches, state
from rillstone.operators.flow import Flow
from rillstone.sources.context import Context


def numbers(spark, n=10):
    return Context(spark).stream_from_generator(n, k=F.col("id").cast("int"), v=F.col("id") * 100 + 0.5)


def test_extract_nulls(spark):
    df = spark.createDataFrame([("0|0|",), ("1||10",), ("||20",), ("7",), ("1|2|3|4",)], "value string")
    assert [tuple(r) for r in Flow(df).extract("a int, b int, c int", "|").df.collect()] == [(0, 0, None), (1, None, 10), (None, None, 20), (7, None, None), (1, 2, 3)]


def test_extract_json(spark):
    df = spark.createDataFrame([('{"key3": 101, "key1": 0, "key2": "10"}',), ('{"key1": null}',)], "value string")
    assert [tuple(r) for r in Flow(df).extract_json("key1 int, key2 int, key3 int").df.collect()] == [(0, 10, 101), (None, None, None)]


def test_sliding_rows(spark):
    out = numbers(spark).sliding_window("row", 3).aggregate(A.sum_("v", "s")).df.orderBy("_seq")
    assert [r.s for r in out.collect()] == [0.5, 101, 301.5, 601.5, 901.5, 1201.5, 1501.5, 1801.5, 2101.5, 2401.5]


@pytest.mark.parametrize(("tumbling", "want"), [(False, [1, 2, 3, 4, 5, 5, 5, 5, 5, 5]), (True, [1, 2, 3, 4, 5, 1, 2, 3, 4, 5])])
def test_range_windows(spark, tumbling, want):
    f = Context(spark).stream_from_generator(10, t=F.timestamp_seconds(F.col("id") + 1), n=F.col("id")).assign_timestamps("t")
    f = f.tumbling_window("range", 5) if tumbling else f.sliding_window("range", 5)
    assert [r.n for r in f.aggregate(A.count(name="n")).df.orderBy("_seq").collect()] == want


def test_running_groups(spark):
    f = Context(spark).stream_from_generator(10, k=F.when(F.col("id") < 5, 0).otherwise(F.col("id")), v=F.col("id") + 0.5).key_by("k").group_by(A.sum_("v", "s"))
    assert [r.s for r in f.df.orderBy("_seq").collect()] == [0.5, 2, 4.5, 8, 12.5, 5.5, 6.5, 7.5, 8.5, 9.5]


def test_join_batch_partition(spark):
    a, b = numbers(spark, 5).key_by("k"), numbers(spark, 8).key_by("k")
    assert a.join(b).df.count() == 5
    assert numbers(spark, 1000).batch(10).df.count() == 100
    assert numbers(spark, 1000).batch(10).unbatch().df.count() == 1000
    f = numbers(spark, 1000).partition_by("k % 3", 3)
    assert f.where("k % 2 = 0").merge().df.count() == 500
    with pytest.raises(ValueError):
        f.partition_by("k", 2)


def test_union_and_stateful(spark):
    c = Context(spark)
    for _ in range(2):
        numbers(spark, 100).to_stream(c, "x")
    assert c.from_stream("x").df.count() == 200
    out = numbers(spark, 50).stateful_map(lambda r, s: ({"_seq": r["_seq"], "t": s + r["k"]}, s + r["k"]), int, "_seq long, t long")
    assert out.df.orderBy(F.desc("_seq")).first().t == sum(range(50))


def test_patterns():
    rows = [{"t": t, "i": i} for i, t in enumerate("abxcabbc")]
    is_ = lambda x: state(lambda e: e["t"] == x)
    ids = lambda p, s="first": ["".join(str(e["i"]) for e in m) for m in run_matches(rows, p, s)]
    assert ids(is_("a") >> is_("b") >> is_("c")) == ["013", "457"]
    assert ids(is_("a") >> is_("b").plus() >> is_("c")) == ["013", "4567"]
    assert ids(is_("a") >> ~is_("x") >> is_("c")) == ["47"]
    assert ids((is_("a") | is_("b")) >> is_("c")) == ["03", "47"]
    assert ids(is_("a") >> is_("c"), "next") == ["03", "47"]
    assert ids((is_("a") >> is_("c")).within("i", 2)) == []


def test_matrices_and_time(spark):
    edges = spark.createDataFrame([(0, 2, 1), (1, 3, 1), (1, 4, 2), (2, 1, 7), (2, 3, 3), (3, 4, 1), (4, 0, 1), (4, 1, 1)], "src long, dst long, w int")
    got = {r.node: r.dist for r in matrices.shortest_paths(edges, 0).collect()}
    assert (got[3], got[4]) == (4, 5)
    assert matrices.spanning_tree(edges).agg(F.sum("w")).first()[0] == 4
    cells = spark.createDataFrame([(i, j, float(i + j)) for i in range(3) for j in range(3)], "i int, j int, v double")
    assert matrices.image_filter(cells).filter("i = 1 and j = 1").first().v == 2.0
    assert matrices.remove_row(cells, 1).count() == 6
    t = spark.createDataFrame([("2012-10-20T15:14:27.841+0000",), ("20121020T151427",), ("1350746067841",), ("x",)], "s string").select(parse_timestamp(F.col("s")).alias("t")).collect()
    assert [r.t for r in t] == [datetime(2012, 10, 20, 15, 14, 27, 841000), datetime(2012, 10, 20, 15, 14, 27), datetime(2012, 10, 20, 15, 14, 27, 841000), None]
