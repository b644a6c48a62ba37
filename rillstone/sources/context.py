"""Sources and the catalogue of named streams, tables and matrices."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.flow import Flow
from rillstone.operators.tables import KeyedTable
from rillstone.sources import network


def checkpointed(df: DataFrame) -> DataFrame:
    """Without lineage, through the folder in spark.checkpoint.dir, or a local one where that is unset and all runs in one process."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="rillstone-"))
    return df.checkpoint(eager=True)


class Context:
    """A session with names: streams (several producers are united), keyed tables, matrices."""

    def __init__(self, spark: SparkSession):
        self.spark, self.streams, self.tables, self.matrices = spark, {}, {}, {}

    def stream_from_file(self, path: str, limit: int = 0) -> Flow:
        """Lines of text (gz and bz2 too), in the order of the file."""
        df = self.spark.read.text(path).withColumn("_seq", F.monotonically_increasing_id())
        return Flow(df.orderBy("_seq").limit(limit) if limit else df, dense=False)

    def stream_from_memory(self, path: str, schema: str, sep: str = ",", limit: int = 0) -> Flow:
        """A file's rows, parsed once and kept for every use of the flow."""
        flow = self.stream_from_file(path, limit).extract(schema, sep)
        return Flow(flow.df.persist(), dense=False)

    def stream_from_csv(self, path: str, schema: str, sep: str = ",") -> Flow:
        return self.stream_from_file(path).extract(schema, sep)

    def stream_from_generator(self, n: int, /, **columns: Column) -> Flow:
        """Rows 0 to n - 1; columns are expressions over id."""
        df = self.spark.range(n)
        return Flow(df.select(*[c.alias(k) for k, c in columns.items()], F.col("id").alias("_seq")))

    def stream_from_parquet(self, path: str, order: list[str], ts: str | None = None) -> Flow:
        return Flow.of(self.spark.read.parquet(path), order, ts)

    def stream_from_rest(self, port: int, path: str = "/", method: str = "POST", **options) -> Flow:
        """Bodies of HTTP requests, column value; a streaming flow."""
        return Flow(network.stream(self.spark, "rillstone.sources.network:Http", port=str(port), path=path, method=method, **options))

    def stream_from_rabbitmq(self, url: str, queue: str, streaming: bool = False) -> Flow:
        return self._queue("Amqp", streaming, url=url, queue=queue)

    def stream_from_mqtt(self, host: str, channel: str, port: int = 1883, streaming: bool = False) -> Flow:
        return self._queue("Mqtt", streaming, host=host, port=str(port), channel=channel)

    def stream_from_zmq(self, path: str, type: str = "sub", binary: bool = False, streaming: bool = True) -> Flow:
        return self._queue("Zmq", streaming, binary, path=path, type=type)

    def _queue(self, client: str, streaming: bool, binary: bool = False, **options) -> Flow:
        """Without streaming, what waits now; the drained rows are checkpointed, as they cannot be read twice."""
        name = f"rillstone.sources.network:{client}"
        return Flow(network.stream(self.spark, name, binary, **options)) if streaming else Flow(checkpointed(network.drain(self.spark, name, binary, **options)).withColumn("_seq", F.monotonically_increasing_id()), dense=False)

    def stream_from_kafka(self, broker: str, topic: str, group: str | None = None, streaming: bool = False) -> Flow:
        """Spark's connector (a package of its own), a task for each partition of the topic: all messages up to now, or a stream."""
        reader = (self.spark.readStream if streaming else self.spark.read).format("kafka").option("kafka.bootstrap.servers", broker).option("subscribe", topic).option("startingOffsets", "earliest")
        df = (reader.option("kafka.group.id", group) if group else reader).load()
        return Flow(df.select(F.col("value").cast("string").alias("value"), "timestamp", "partition", "offset"))

    def stream_from_table(self, name: str, mode: str = "immediate") -> Flow:
        """The table's changes in order: all of them, or (mode 'commit') those before its last commit."""
        return Flow(self.tables[name].changes(mode), dense=False)

    def select_from_table(self, name: str, predicate: Column | None = None) -> Flow:
        return Flow(self.tables[name].select(predicate))

    def stream_from_matrix(self, name: str) -> Flow:
        return Flow(self.matrices[name], dense=False)

    def from_tx_tables(self, names: list[str], n: int, at: int, seed: int = 0) -> DataFrame:
        """The same n random keys of several transactional tables, as all of them stood after one commit."""
        tables = [self.tables[x] for x in names]
        first = tables[0].read(at)
        keys = first.select(F.col(tables[0].key).alias("_k")).orderBy(F.xxhash64("_k", F.lit(seed)), "_k").limit(n)
        out = keys
        for x, t in zip(names, tables, strict=True):
            rows = t.read(at)
            out = out.join(rows.select(*[F.col(c).alias(f"{x}_{c}") for c in rows.columns]), F.col("_k") == F.col(f"{x}_{t.key}"), "left")
        return out.withColumnRenamed("_k", "key")

    def stream_from_linear_road(self, path: str) -> Flow:
        """The 15 integers of a road report, in the order of the file."""
        names = "type time vid speed xway lane dir seg pos qid sinit send dow tod day".split()
        return self.stream_from_csv(path, ", ".join(f"{x} int" for x in names))

    def from_stream(self, name: str) -> Flow:
        return self.streams[name]

    def publish(self, name: str, flow: Flow) -> None:
        self.streams[name] = self.streams[name].union(flow) if name in self.streams else flow

    def create_table(self, name: str, df: DataFrame, key: str) -> KeyedTable:
        self.tables[name] = KeyedTable(df, key)
        return self.tables[name]

    def add_table(self, name: str, table):
        """A table of any kind, such as one opened from a folder or a transactional one."""
        self.tables[name] = table
        return table

    def drop_table(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)
        self.tables.pop(name).truncate()

    def create_matrix(self, name: str, cells: DataFrame) -> DataFrame:
        self.matrices[name] = cells
        return cells

    def sql(self, text: str) -> DataFrame:
        """Over the tables as they are now."""
        for name, t in self.tables.items():
            t.select().createOrReplaceTempView(name)
        return self.spark.sql(text)

    def run_every(self, seconds: float, times: int, action: Callable[[], None]) -> None:
        import time

        for _ in range(times):
            action()
            time.sleep(seconds)
