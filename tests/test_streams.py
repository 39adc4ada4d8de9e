"""Sources, sinks, streams and workflows."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from rillwork.errors import ValidationError
from rillwork.functions import udf
from rillwork.operators import aggregate
from rillwork.plans.workflow import Workflow
from rillwork.sources import http, readers, writers
from rillwork.streaming import windows


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b", None), (2, "c", 2.5)], "i int, s string, d double")
    for kind in ("CSV", "JSON", "PARQUET"):
        path = str(tmp_path / kind)
        writers.file_writer(path, kind, delimiter=";")(df)
        back = readers.file_reader([path], kind, ";", True, [("i", "INTEGER"), ("s", "STRING"), ("d", "DOUBLE")])(spark)
        assert sorted(map(tuple, back.collect())) == [(1, "a;b", None), (2, "c", 2.5)]
    writers.file_writer(str(tmp_path / "one"), "TEXT", single_file=True)(df)
    assert len([f for f in os.listdir(tmp_path / "one") if f.startswith("part")]) == 1
    both = readers.multiple_readers([readers.file_reader([str(tmp_path / "PARQUET")], "PARQUET")] * 2, ["INNER_JOIN"], "i")(spark)
    assert both.count() == 2
    from datetime import datetime

    assert writers.dated_path("/x/${yyyyMMdd}/y", datetime(2024, 3, 5)) == "/x/20240305/y"


def test_messages_and_fitting(spark):
    raw = spark.createDataFrame([('{"sensorId":"a","sensorType":1,"event":"e","timestamp":"2024-01-01 00:00:00"}',), ("broken",)], "value string")
    got = readers.parse_messages(raw).collect()
    assert got[0].sensorId == "a" and got[0].timestamp.year == 2024 and got[1].sensorId is None
    fitted = readers.fitted(spark.createDataFrame([("x", "5")], "a string, b string"), [("a", "INTEGER"), ("b", "LONG"), ("c", "STRING")])
    assert tuple(fitted.first()) == (None, 5, None)
    assert json.loads(writers.as_json(spark.range(1)).first().value) == {"id": 0}


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.range(0, 40).selectExpr("id % 3 as k", "id as v", "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as ts")
    path = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(path)
    return path, rows


def test_stream_equals_batch(spark, folder, tmp_path):
    path, rows = folder
    op = aggregate.group_by(["k"], ["v"], ["SUM"], {"key": "ts", "length": "10 minutes", "slide": "5 minutes"})
    stream = windows.watermark("ts", "1 hour")(spark.readStream.schema(rows.schema).parquet(path))
    q = writers.memory_pipe("stream_equals_batch", "complete")(op(stream))
    q.awaitTermination()
    assert sorted(map(str, spark.table("stream_equals_batch").collect())) == sorted(map(str, op(rows).collect()))


@pytest.mark.parametrize(("size", "slide"), [(3, 1), (4, 2), (2, 5), (3, 3)])
def test_count_windows(spark, folder, tmp_path, size, slide):
    path, rows = folder
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
    rows.where("v >= 20").selectExpr("k", "v + 100 as v", "ts").coalesce(1).write.mode("append").parquet(path)
    q = writers.file_pipe(str(tmp_path / "out"), str(tmp_path / "state"), "PARQUET")(windows.count_windows(["k"], ["v"], size, slide)(reader.parquet(path)))
    q.awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault((r.k, r.window_id), []).append(r.v)
    for k in range(3):
        seq = [v for v in [*range(40), *range(120, 140)] if (v if v < 100 else v - 100) % 3 == k]
        want = [seq[i : i + size] for i in range(0, len(seq) - size + 1, slide)]
        assert [sorted(got[k, w]) for w in range(len(want))] == want and (k, len(want)) not in got


def test_http_source(spark):
    http.register_http(spark)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(self.path.encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    got = spark.read.format("http_poll").option("url", f"http://127.0.0.1:{server.server_port}/a").option("params", '{"x": 1}').load().collect()
    server.shutdown()
    assert [tuple(r) for r in got] == [("/a?x=1", 200)]


def test_workflow(spark, tmp_path):
    spark.range(10).toDF("x").write.parquet(str(tmp_path / "in"))
    flow = {
        "engines": [
            {"id": 2, "prev": 1, "readers": [{"reader": "file", "paths": [str(tmp_path / "mid")], "kind": "PARQUET"}], "operators": [{"op": "top_k", "column": "x", "n": 2}], "writers": [{"writer": "file", "path": str(tmp_path / "out"), "kind": "JSON"}]},
            {"id": 1, "readers": [{"reader": "file", "paths": [str(tmp_path / "in")], "kind": "PARQUET"}], "operators": [{"op": "filter_rows", "column": "x", "condition": "LARGE_THAN", "value": 4}], "writers": [{"writer": "file", "path": str(tmp_path / "mid"), "kind": "PARQUET"}]},
        ]
    }
    Workflow.load(json.dumps(flow)).run(spark)
    assert sorted(r.x for r in spark.read.json(str(tmp_path / "out")).collect()) == [5, 6]
    with pytest.raises(ValidationError):
        Workflow.load({"engines": [{"id": 1, "prev": 9}]}).run(spark)
    assert Workflow.load({"engines": [], "run_type": {"kind": "EVERY_MINUTE"}}).trigger() == {"processingTime": "1 minute"}


def test_streaming_workflow_fans_out(spark, tmp_path):
    spark.range(6).selectExpr("id as x").write.json(str(tmp_path / "in"))
    twice = {"reader": "multiple", "readers": [{"reader": "file", "paths": [str(tmp_path / "in")], "kind": "JSON"}] * 2, "kinds": ["CONCAT"]}
    to = [{"writer": "file", "path": str(tmp_path / name), "kind": "JSON", "mode": "APPEND"} for name in ("a", "b")]
    flow = {
        "run_type": {"kind": "ONCE"},
        "engines": [
            {"id": 1, "readers": [{"reader": "file_pipe", "path": str(tmp_path / "in"), "kind": "JSON", "fields": [["x", "LONG"]], "time": None}], "operators": [{"op": "filter_rows", "column": "x", "condition": "LARGE_THAN", "value": 3}], "writers": [{"writer": "batch_pipe", "to": to, "checkpoint": str(tmp_path / "state")}]},
            {"id": 2, "prev": 1, "readers": [twice], "writers": [{"writer": "file", "path": str(tmp_path / "c"), "kind": "JSON"}]},
        ],
    }
    Workflow.load(flow).run(spark)
    assert [sorted(r.x for r in spark.read.json(str(tmp_path / n)).collect()) for n in "ab"] == [[4, 5], [4, 5]]
    assert spark.read.json(str(tmp_path / "c")).count() == 12


def test_functions(spark):
    assert spark.range(1).select(udf.register_scalar(spark, "inc", lambda x: x + 1, "long")("id")).first()[0] == 1
    assert udf.geometric_mean(__import__("pandas").Series([1.0, 4.0])) == pytest.approx(2.0)
    assert spark.range(3).select(udf.route_lookup(F.col("id").cast("int"), {0: "a"})).collect()[1][0] is None
