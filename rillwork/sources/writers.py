"""Writers. Batch writers run at once; streaming writers start a query and return it."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..columns import col
from .readers import FORMATS

MODES = {"APPEND": "append", "OVERWRITE": "overwrite", "ERROR_IF_EXISTS": "errorifexists", "IGNORE": "ignore"}


def as_json(df: DataFrame, name: str = "value") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*map(col, df.columns))).alias(name))


def _plain_vectors(df: DataFrame) -> DataFrame:
    """Vectors as JSON, as text formats can't hold them."""
    vectors = [f.name for f in df.schema.fields if f.dataType.typeName() == "vectorudt"]
    if not vectors:
        return df
    from pyspark.ml.functions import vector_to_array

    return df.withColumns({c: F.to_json(F.struct(vector_to_array(col(c)).alias("values"))) for c in vectors})


def file_writer(path: str, kind: str = "CSV", mode: str = "OVERWRITE", header: bool = True, delimiter: str = ",", single_file: bool = False, partition_by: list[str] = ()) -> Callable[[DataFrame], None]:
    """A folder of files, written in parallel; one file only on request."""

    def write(df: DataFrame) -> None:
        df = _plain_vectors(df) if kind in ("CSV", "TEXT") else df
        if kind == "TEXT" and len(df.columns) > 1:
            df = df.select(F.concat_ws(delimiter, *(col(c).cast("string") for c in df.columns)).alias("value"))
        w = (df.coalesce(1) if single_file else df).write.mode(MODES[mode]).format(FORMATS[kind])
        if kind == "CSV":
            w = w.option("header", header).option("sep", delimiter)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.save(path)

    return write


def dated_path(path: str, now: datetime | None = None) -> str:
    """A path with `${pattern}` replaced by the time, pattern letters yyyy MM dd HH mm ss."""
    signs = {"yyyy": "%Y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}
    return re.sub(r"\$\{([^}]*)\}", lambda m: (now or datetime.now()).strftime(re.sub("yyyy|MM|dd|HH|mm|ss", lambda x: signs[x.group()], m.group(1))), path)


def table_writer(url: str, table: str, user: str = "", password: str = "", mode: str = "append", **options: str) -> Callable[[DataFrame], None]:
    return lambda df: df.write.format("jdbc").options(url=url, dbtable=table, user=user, password=password, **options).mode(mode).save()


def connector_writer(form: str, mode: str = "append", **options: str) -> Callable[[DataFrame], None]:
    """A sink whose connector is on the class path (`mongodb`, `phoenix`, ...)."""
    return lambda df: df.write.format(form).options(**options).mode(mode).save()


def kafka_writer(servers: str, topic: str) -> Callable[[DataFrame], None]:
    return lambda df: as_json(df).write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic}).save()


def http_writer(url: str, method: str = "POST", column: str | None = None, headers: dict[str, str] | None = None, timeout: float = 30) -> Callable[[DataFrame], None]:
    """Each row as JSON, or one column, to a URL, from the executors."""

    def send(rows) -> None:
        from urllib.request import Request, urlopen

        for r in rows:
            urlopen(Request(url, (r[0] or "").encode(), {"Content-Type": "application/json"} | (headers or {}), method=method), timeout=timeout).close()

    return lambda df: (df.select(col(column).cast("string")) if column else as_json(df)).foreachPartition(send)


def stdout_writer(rows: int = 10) -> Callable[[DataFrame], None]:
    def write(df: DataFrame) -> None:
        df.printSchema()
        df.show(rows)

    return write


def _started(df: DataFrame, form: str, mode: str, trigger: str | None, checkpoint: str | None, path: str | None = None, **options: str) -> StreamingQuery:
    w = df.writeStream.format(form).outputMode(mode).options(**options)
    w = w.trigger(availableNow=True) if trigger is None else w.trigger(processingTime=trigger)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    return w.start(path) if path else w.start()


def console_pipe(mode: str = "append", trigger: str | None = None) -> Callable[[DataFrame], StreamingQuery]:
    return lambda df: _started(df, "console", mode, trigger, None)


def file_pipe(path: str, checkpoint: str, kind: str = "JSON", mode: str = "append", trigger: str | None = None) -> Callable[[DataFrame], StreamingQuery]:
    return lambda df: _started(_plain_vectors(df), FORMATS[kind], mode, trigger, checkpoint, path)


def kafka_pipe(servers: str, topic: str, checkpoint: str, mode: str = "append", trigger: str | None = None) -> Callable[[DataFrame], StreamingQuery]:
    return lambda df: _started(as_json(df), "kafka", mode, trigger, checkpoint, **{"kafka.bootstrap.servers": servers, "topic": topic})


def memory_pipe(table: str, mode: str = "append", trigger: str | None = None) -> Callable[[DataFrame], StreamingQuery]:
    return lambda df: _started(df, "memory", mode, trigger, None, queryName=table)


def connector_pipe(form: str, checkpoint: str, mode: str = "append", trigger: str | None = None, **options: str) -> Callable[[DataFrame], StreamingQuery]:
    return lambda df: _started(df, form, mode, trigger, checkpoint, **options)


def batch_pipe(write: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append", trigger: str | None = None) -> Callable[[DataFrame], StreamingQuery]:
    """Each micro-batch to a function, e.g. a batch writer with `dated_path`, or several writers (fan-out)."""

    def start(df: DataFrame) -> StreamingQuery:
        w = df.writeStream.outputMode(mode).foreachBatch(write)
        if checkpoint:
            w = w.option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if trigger is None else w.trigger(processingTime=trigger)).start()

    return start
