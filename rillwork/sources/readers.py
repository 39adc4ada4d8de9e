"""Readers of batch and streaming sources: each is a function of a session that returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import schema_of
from ..errors import ValidationError
from ..operators.joins import merge_tables
from ..streaming.windows import watermark

Reader = Callable[[SparkSession], DataFrame]
FORMATS = {"CSV": "csv", "JSON": "json", "PARQUET": "parquet", "TEXT": "text"}
#: The fields of a sensor message where no other schema is given.
SENSOR_FIELDS = (("sensorId", "STRING"), ("sensorType", "INTEGER"), ("event", "STRING"), ("timestamp", "TIMESTAMP"))


def _configured(reader, kind: str, delimiter: str, header: bool, fields):
    form = FORMATS[kind]
    reader = reader.format(form)
    if form == "csv":
        reader = reader.option("sep", delimiter).option("header", header)
        if not fields:
            reader = reader.option("inferSchema", True)
    return reader.schema(schema_of(fields)) if fields else reader


def file_reader(paths: list[str], kind: str = "JSON", delimiter: str = ",", header: bool = False, fields: list[tuple[str, str]] = ()) -> Reader:
    """Files or folders. Give `fields`: without them CSV and JSON are read once more to infer types."""
    return lambda spark: _configured(spark.read, kind, delimiter, header, fields).load(list(paths))


def privacy_reader(paths: list[str], fields: list[tuple[str, str]] = (), delimiter: str = ";", header: bool = True) -> Reader:
    return file_reader(paths, "CSV", delimiter, header, fields)


def multiple_readers(readers: list[Reader], kinds: list[str], key: str = "TIMESTAMP", order_by: list | None = None) -> Reader:
    """Several sources folded by CONCAT, INNER_JOIN, OUTER_JOIN or APPEND."""
    return lambda spark: merge_tables(kinds, key, order_by)(*(r(spark) for r in readers))


def table_reader(url: str, table: str, user: str = "", password: str = "", driver: str | None = None, partition: tuple[str, int, int, int] | None = None) -> Reader:
    """A JDBC table; `partition` (column, low, high, parts) reads it in parallel."""

    def read(spark: SparkSession) -> DataFrame:
        r = spark.read.format("jdbc").options(url=url, dbtable=table, user=user, password=password)
        if driver:
            r = r.option("driver", driver)
        if partition:
            c, low, high, parts = partition
            r = r.options(partitionColumn=c, lowerBound=low, upperBound=high, numPartitions=parts)
        return r.load()

    return read


def sql_reader(url: str, queries: list[str], **options: str) -> Reader:
    """The results of several statements through JDBC, one after another in one table."""

    def read(spark: SparkSession) -> DataFrame:
        parts = [table_reader(url, f"({q}) q{i}", **options)(spark) for i, q in enumerate(queries)]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    return read


def connector_reader(form: str, fields: list[tuple[str, str]] = (), clean: bool = False, **options: str) -> Reader:
    """A source whose connector is on the class path (`mongodb`, `phoenix`, ...). With `clean`, values that don't fit
    `fields` become null; without fields the store's own `_id` is left out."""

    def read(spark: SparkSession) -> DataFrame:
        df = spark.read.format(form).options(**options).load()
        if not fields:
            return df.drop("_id")
        return fitted(df, fields) if clean else df.select(*(n for n, _ in fields))

    return read


def fitted(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """Columns by name, cast to the declared types; what doesn't fit or is absent is null."""
    want = schema_of(fields)
    return df.select(*((F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields))


def kafka_reader(servers: str, topic: str, starting: str = "latest", fail_on_data_loss: bool = False, streaming: bool = True) -> Reader:
    """Raw Kafka records; needs the Kafka package on the class path."""

    def read(spark: SparkSession) -> DataFrame:
        r = (spark.readStream if streaming else spark.read).format("kafka")
        return r.options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": str(fail_on_data_loss).lower()}).load()

    return read


def parse_messages(raw: DataFrame, fields: list[tuple[str, str]] = SENSOR_FIELDS, time: str = "timestamp", add_time: bool = False, delay: str | None = None, pattern: str | None = None) -> DataFrame:
    """`value` as JSON to columns, its time parsed or (add_time) set to now, and a watermark if `delay` is given."""
    schema = schema_of(fields)
    read = T.StructType([T.StructField(f.name, T.StringType() if f.name == time and pattern else f.dataType) for f in schema.fields])
    df = raw.select(F.from_json(F.col("value").cast("string"), read).alias("m")).select("m.*")
    if add_time:
        df = df.withColumn(time, F.current_timestamp())
    elif pattern:
        df = df.withColumn(time, F.try_to_timestamp(F.col(time), F.lit(pattern)))
    return watermark(time, delay)(df) if delay else df


def kafka_pipe_reader(servers: str, topic: str, fields: list[tuple[str, str]] = SENSOR_FIELDS, **parse: object) -> Reader:
    return lambda spark: parse_messages(kafka_reader(servers, topic)(spark), fields, **parse)


def schema_of_sample(spark: SparkSession, path: str) -> T.StructType:
    """The schema of a sample file of JSON messages."""
    return spark.read.json(path).schema


def file_pipe_reader(path: str, kind: str = "JSON", fields: list[tuple[str, str]] = (("value", "STRING"),), time: str | None = "timestamp", delay: str | None = None, max_files: int | None = None, delimiter: str = ",", header: bool = False) -> Reader:
    """A stream of the files that appear in a folder; any interval text is a watermark."""
    if kind not in FORMATS:
        raise ValidationError(f"unknown format {kind!r}")

    def read(spark: SparkSession) -> DataFrame:
        r = _configured(spark.readStream, kind, delimiter, header, fields)
        if max_files:
            r = r.option("maxFilesPerTrigger", max_files)
        df = r.load(path)
        return watermark(time, delay)(df) if delay and time in df.columns else df

    return read
