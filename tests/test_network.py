"""Queues as sources and sinks, serialised rows, triggers by time, window functions."""

import socket
import time
import urllib.error
import urllib.request
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rillstone.functions import aggregates as A
from rillstone.operators.flow import Flow
from rillstone.sources import network
from rillstone.sources.context import Context


def post(port, body, path="/in", method="POST"):
    return urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", data=body, method=method), timeout=10).status


def test_requests_are_rows(spark, tmp_path):
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    flow = Context(spark).stream_from_rest(port, "/in").extract("k int, name string").where("k > 0")
    q = flow.df.writeStream.format("memory").queryName("requests").option("checkpointLocation", str(tmp_path)).start()
    try:
        for _ in range(100):
            try:
                assert post(port, b"0,none") == 200
                break
            except (urllib.error.URLError, ConnectionError):
                time.sleep(0.2)
        assert post(port, b"1,a") == 200
        q.processAllAvailable()
        assert post(port, "2,é".encode()) == 200
        with pytest.raises(urllib.error.HTTPError):
            post(port, b"3,x", path="/other")
        deadline = time.time() + 60
        while spark.table("requests").count() < 2 and time.time() < deadline:
            time.sleep(0.3)
        assert sorted(map(tuple, spark.table("requests").collect())) == [(1, "a"), (2, "é")]
    finally:
        q.stop()


def test_drain_and_send(spark, tmp_path):
    box = str(tmp_path / "box")
    data = Flow(spark.createDataFrame([(1, "a", False), (2, None, False), (3, "c", True)], "k int, s string, _outdated boolean"))
    data.send("tests.folder_queue:Folder", box=box)
    df = network.drain(spark, "tests.folder_queue:Folder", box=box)
    assert sorted(r.value for r in df.collect()) == ["1,a", "2,"]
    assert network.drain(spark, "tests.folder_queue:Folder", box=box).collect() == []
    data.send("tests.folder_queue:Folder", binary=True, box=box)
    back = Flow(network.drain(spark, "tests.folder_queue:Folder", binary=True, box=box)).deserialize("k int, s string")
    assert sorted(map(tuple, back.df.collect())) == [(1, "a"), (2, None)]


def test_a_batch_that_was_not_committed_is_read_again():
    class Memory(network.Client):
        def __init__(self):
            super().__init__({})
            self.waiting, self.acked = [b"a", b"b", b"c"], 0

        def poll(self):
            return self.waiting.pop(0) if self.waiting else None

        def ack(self, n):
            self.acked += n

    from pyspark.sql.types import StructType

    reader = network._Stream({"client": "x:y", "maxperbatch": "2"}, StructType.fromDDL("value string"))
    reader.client, reader.held, reader.first = Memory(), [], 0
    got, end = reader.read({"n": 0})
    assert (list(got), end) == ([("a",), ("b",)], {"n": 2})
    assert list(reader.readBetweenOffsets({"n": 0}, end)) == [("a",), ("b",)]
    assert reader.client.acked == 0
    reader.commit(end)
    assert reader.client.acked == 2
    got, end = reader.read(end)
    assert (list(got), end) == ([("c",)], {"n": 3})
    assert list(reader.readBetweenOffsets({"n": 2}, {"n": 3})) == [("c",)]


def test_serialised_rows_come_back(spark):
    schema = "a long, b double, s string, t timestamp, x binary, l array<int>"
    data = [(1, 0.1, "é\n", datetime(2020, 1, 2, 3, 4, 5, 678901), bytearray(b"\x00\xff"), [1, None]), (None, None, None, None, None, None), (2, float("inf"), "", None, bytearray(b""), [])]
    flow = Flow(spark.createDataFrame(data, schema)).serialize()
    assert flow.df.dtypes == [("value", "binary")]
    assert [tuple(r) for r in flow.deserialize(schema).df.collect()] == data
    bad = Flow(spark.createDataFrame([(bytearray(b"\xff\xfe"),), (bytearray(b"no"),), (None,)], "value binary")).deserialize("a long")
    assert [r.a for r in bad.df.collect()] == [None, None, None]


@pytest.mark.parametrize("part", [False, True])
def test_trigger_by_time(spark, part):
    """A row goes on if it is five seconds after the one that did before."""
    f = Context(spark).stream_from_generator(10, t=F.timestamp_seconds(F.col("id") + 1), p=F.lit(0)).assign_timestamps("t")
    f = f.partition_by("p", 1) if part else f
    out = f.tumbling_window("range", 5).aggregate(A.count(name="n"), seconds=5)
    assert [r.n for r in out.df.orderBy("_seq").collect()] == [5, 5]
    out = Context(spark).stream_from_generator(10, t=F.timestamp_seconds(F.col("id") * 3 + 1)).assign_timestamps("t").aggregate(A.count(name="n"), seconds=5)
    assert [r.n for r in out.df.orderBy("_seq").collect()] == [3, 5, 7, 9]


def test_window_functions_and_custom_aggregates(spark):
    f = Context(spark).stream_from_generator(10, k=F.col("id").cast("int"), v=F.col("id") * 100 + 0.5)
    middle = f.sliding_window("row", 5).fold("m", "k", lambda xs: F.get(F.array_sort(xs), F.floor(F.size(xs) / 2 - 0.01).cast("int")))
    assert [r.m for r in middle.df.orderBy("_seq").collect()] == [0, 0, 1, 1, 2, 3, 4, 5, 6, 7]
    product = A.custom(lambda x: F.exp(F.sum(F.ln(x))), "v", "p")
    assert f.where("k < 3").aggregate(product, emit="final").df.first().p == pytest.approx(0.5 * 100.5 * 200.5)
    assert f.key_by("k").groupby_key(A.TYPED["IntSum"]("k", "s"), emit="final").df.count() == 10
