"""Queues on the network as data sources: HTTP requests, AMQP, MQTT and ZeroMQ, each behind one small client.

A client has open(), poll() -> bytes or None when nothing waits, ack(n) for the oldest n messages, send(bytes) and close(). The
stream reader gives at most maxPerBatch messages a micro-batch and acknowledges them only when Spark has committed the batch, so
a failed batch is read again. The batch reader takes what waits and ends, one connection in one task; it acknowledges as it goes.
Kafka has partitions of its own and goes through Spark's connector, not through here.
"""

from __future__ import annotations

import importlib
import queue
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.types import BinaryType

FORMAT = "rillstone_queue"
PER_BATCH = 10_000


class Client:
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def open(self) -> None: ...

    def poll(self) -> bytes | None:
        raise NotImplementedError

    def ack(self, n: int) -> None: ...

    def send(self, message: bytes) -> None:
        raise NotImplementedError

    def close(self) -> None: ...


class Http(Client):
    """Serves host:port; the body of each request of the given method to path is a message, anything else gets 404. At most maxWaiting bodies wait, further requests get 503."""

    def open(self) -> None:
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        path, method = self.options.get("path", "/"), self.options.get("method", "POST").upper()
        self.bodies = bodies = queue.Queue(int(self.options.get("maxwaiting", 100_000)))

        class Handler(BaseHTTPRequestHandler):
            def _take(self) -> None:
                code = 404
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                if self.command == method and self.path.split("?")[0] == path:
                    try:
                        bodies.put_nowait(body)
                        code = 200
                    except queue.Full:
                        code = 503
                self.send_response(code)
                self.send_header("Content-Length", "0")
                self.end_headers()

            do_GET = do_POST = do_PUT = do_DELETE = _take

            def log_message(self, *_) -> None: ...

        self.server = ThreadingHTTPServer((self.options.get("host", "127.0.0.1"), int(self.options["port"])), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def poll(self) -> bytes | None:
        try:
            return self.bodies.get_nowait()
        except queue.Empty:
            return None

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()


class Amqp(Client):
    """Options url and queue."""

    def open(self) -> None:
        import pika

        self.connection = pika.BlockingConnection(pika.URLParameters(self.options["url"]))
        self.channel, self.tags = self.connection.channel(), []

    def poll(self) -> bytes | None:
        method, _, body = self.channel.basic_get(self.options["queue"])
        if method is None:
            return None
        self.tags.append(method.delivery_tag)
        return body

    def ack(self, n: int) -> None:
        if n:
            self.channel.basic_ack(self.tags[n - 1], multiple=True)
            del self.tags[:n]

    def send(self, message: bytes) -> None:
        self.channel.basic_publish("", self.options["queue"], message)

    def close(self) -> None:
        self.connection.close()


class Mqtt(Client):
    """Options host, port, channel; quality of service 1."""

    def open(self) -> None:
        from paho.mqtt import client as mqtt

        self.arrived: queue.Queue = queue.Queue()
        self.client = mqtt.Client(mqtt.CallbackAPIVersion.VERSION2, manual_ack=True)
        self.client.on_message = lambda _c, _u, m: self.arrived.put(m)
        self.client.connect(self.options["host"], int(self.options.get("port", 1883)))
        self.client.subscribe(self.options["channel"], qos=1)
        self.client.loop_start()
        self.held: list = []

    def poll(self) -> bytes | None:
        try:
            m = self.arrived.get(timeout=float(self.options.get("wait", 0.2)))
        except queue.Empty:
            return None
        self.held.append(m)
        return m.payload

    def ack(self, n: int) -> None:
        for m in self.held[:n]:
            self.client.ack(m.mid, m.qos)
        del self.held[:n]

    def send(self, message: bytes) -> None:
        self.client.publish(self.options["channel"], message, qos=1).wait_for_publish()

    def close(self) -> None:
        self.client.loop_stop()
        self.client.disconnect()


class Zmq(Client):
    """Options path and type: sub or pull to read, pub or push to write. The socket knows no acknowledgement."""

    def open(self) -> None:
        import zmq

        kind = self.options.get("type", "sub").upper()
        self.socket = zmq.Context.instance().socket(getattr(zmq, kind))
        if kind in ("PUB", "PUSH"):
            self.socket.bind(self.options["path"])
            return
        self.socket.connect(self.options["path"])
        if kind == "SUB":
            self.socket.setsockopt(zmq.SUBSCRIBE, b"")

    def poll(self) -> bytes | None:
        return self.socket.recv() if self.socket.poll(int(1000 * float(self.options.get("wait", 0.2)))) else None

    def send(self, message: bytes) -> None:
        self.socket.send(message)

    def close(self) -> None:
        self.socket.close()


def _client(options: dict) -> Client:
    """Option client: module:Class."""
    module, name = options["client"].split(":")
    return getattr(importlib.import_module(module), name)(dict(options))


class QueueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"value {self.options.get('as', 'string')}"

    def reader(self, schema) -> DataSourceReader:
        return _Drain(self.options, schema)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Send(self.options)


class _Reading:
    def __init__(self, options, schema):
        self.options, self.binary = dict(options), isinstance(schema["value"].dataType, BinaryType)

    def row(self, message: bytes) -> tuple:
        return (bytes(message) if self.binary else message.decode("utf-8", "replace"),)


class _Drain(_Reading, DataSourceReader):
    def read(self, partition) -> Iterator[tuple]:
        client = _client(self.options)
        client.open()
        try:
            while (message := client.poll()) is not None:
                yield self.row(message)
                client.ack(1)
        finally:
            client.close()


class _Stream(_Reading, SimpleDataSourceStreamReader):
    """Offsets count messages. What is not committed is held, at most one batch ahead of the commit."""

    client: Client | None = None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        if self.client is None:
            self.client, self.held, self.first = _client(self.options), [], start["n"]
            self.client.open()
        got: list[bytes] = []
        most = int(self.options.get("maxperbatch", PER_BATCH))
        while len(got) < most and (message := self.client.poll()) is not None:
            got.append(message)
        self.held.extend(got)
        return iter([self.row(m) for m in got]), {"n": start["n"] + len(got)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if self.client is None:
            return iter([])
        return iter([self.row(m) for m in self.held[start["n"] - self.first : end["n"] - self.first]])

    def commit(self, end: dict) -> None:
        if self.client is not None and end["n"] > self.first:
            n = end["n"] - self.first
            self.client.ack(n)
            del self.held[:n]
            self.first = end["n"]


class _Send(DataSourceWriter):
    """Each task sends its rows over a connection of its own; retractions must be filtered ahead."""

    def __init__(self, options):
        self.options = dict(options)

    def write(self, rows) -> WriterCommitMessage:
        client = _client(self.options)
        client.open()
        try:
            for row in rows:
                if row[0] is not None:
                    client.send(bytes(row[0]) if isinstance(row[0], bytes | bytearray) else str(row[0]).encode())
        finally:
            client.close()
        return WriterCommitMessage()


def stream(spark: SparkSession, client: str, binary: bool = False, **options) -> DataFrame:
    """A streaming DataFrame (value) of a client given as module:Class."""
    spark.dataSource.register(QueueSource)
    return spark.readStream.format(FORMAT).options(client=client, **{"as": "binary" if binary else "string"}, **options).load()


def drain(spark: SparkSession, client: str, binary: bool = False, **options) -> DataFrame:
    """What waits now, as a batch. Spark may run a source twice for two actions: materialise it first."""
    spark.dataSource.register(QueueSource)
    return spark.read.format(FORMAT).options(client=client, **{"as": "binary" if binary else "string"}, **options).load()


def send(df: DataFrame, client: str, **options) -> None:
    """The only column of df, string or binary, as messages."""
    df.sparkSession.dataSource.register(QueueSource)
    df.write.format(FORMAT).options(client=client, **options).mode("append").save()
