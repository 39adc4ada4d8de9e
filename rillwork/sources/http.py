"""HTTP as a data source (Python Data Source API): `http_poll` asks a URL again and again, as a batch
(once) or a stream; `http_listen` collects what is posted to a port."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from queue import Empty, SimpleQueue

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "value string, status int"


def ask(options: dict[str, str]) -> tuple[str, int]:
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    url, method = options["url"], options.get("method", "GET").upper()
    if params := json.loads(options.get("params", "{}")):
        url += ("&" if "?" in url else "?") + urlencode(params)
    body = options.get("body")
    request = Request(url, body.encode() if body is not None else None, json.loads(options.get("headers", "{}")), method=method)
    try:
        with urlopen(request, timeout=float(options.get("timeout", 30))) as r:
            return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.status
    except HTTPError as e:
        return e.read().decode("utf-8", "replace"), e.code


class _Once(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int]]:
        yield ask(self.options)


class _Again(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.kept: dict[int, tuple[str, int]] = {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[str, int]], dict]:
        n = start["n"]
        if n >= int(self.options.get("polls", 2**31)):
            return iter([]), start
        self.kept[n] = ask(self.options)
        return iter([self.kept[n]]), {"n": n + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str, int]]:
        return iter([self.kept[i] if i in self.kept else ask(self.options) for i in range(start["n"], end["n"])])

    def commit(self, end: dict) -> None:
        for i in [i for i in self.kept if i < end["n"]]:
            del self.kept[i]


class HttpPoll(DataSource):
    """Options: url, method, params and headers (JSON objects), body, timeout, polls (a stream's greatest number)."""

    @classmethod
    def name(cls) -> str:
        return "http_poll"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Once(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Again(self.options)


class _Inbox(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.queue, self.kept, self.n = options, SimpleQueue(), {}, 0
        self.server = None

    def _listen(self) -> None:
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        queue, path = self.queue, self.options.get("path", "/")

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:
                ok = self.path == path
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
                if ok:
                    queue.put(body)
                self.send_response(200 if ok else 404)
                self.end_headers()

            def log_message(self, *args: object) -> None:
                pass

        self.server = ThreadingHTTPServer((self.options.get("ip", "0.0.0.0"), int(self.options["port"])), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[str, int]], dict]:
        if self.server is None:
            self._listen()
        n = start["n"]
        while True:
            try:
                self.kept[n] = (self.queue.get_nowait(), 200)
                n += 1
            except Empty:
                break
        return iter([self.kept[i] for i in range(start["n"], n)]), {"n": n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str, int]]:
        return iter([self.kept[i] for i in range(start["n"], end["n"]) if i in self.kept])

    def commit(self, end: dict) -> None:
        for i in [i for i in self.kept if i < end["n"]]:
            del self.kept[i]


class HttpListen(DataSource):
    """Options: port, ip, path. What has been received but not committed is lost if the driver is."""

    @classmethod
    def name(cls) -> str:
        return "http_listen"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Inbox(self.options)


def register_http(spark: SparkSession) -> None:
    spark.dataSource.register(HttpPoll)
    spark.dataSource.register(HttpListen)
