"""Session factory and the few settings that operators read from the session."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ProcessError


def make_session(app: str = "rillwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow. Values given in `conf` win (dots as `__`)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.aggregatePushdown": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the cluster's `spark.checkpoint.dir` is kept, a
    private folder is set only where the session has none (tests, local runs)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark))


def local_folder(spark: SparkSession) -> str:
    """A temporary folder of this machine; an error on a cluster, whose other machines would not see it."""
    if not spark.sparkContext.master.startswith("local"):
        raise ProcessError("a cluster needs a shared folder: set spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="rillwork-")


def is_small(df: DataFrame, rows: int) -> bool:
    """True if the table has at most `rows` rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def hint_small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """A broadcast hint for a table of checked size; larger tables are left to Catalyst."""
    return F.broadcast(df) if is_small(df, rows) else df


def wall_micros(col: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp's wall clock, whatever the session's zone is."""
    c = F.col(col) if isinstance(col, str) else col
    whole = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
