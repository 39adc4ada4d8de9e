"""Grouping, time windows, pivots, frequencies and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import ColumnRef, col, is_numeric, is_text, name_of, names_of
from ..errors import ValidationError
from ..registry import Op, operator
from .ranks import median_of

#: The aggregate functions that can be named; AVG is what other names mean.
FUNCTIONS = {"avg": F.avg, "mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "median": F.median, "average": F.avg}


def function(name: str):
    return FUNCTIONS.get(name.lower(), F.avg)


@operator("aggregate")
def aggregate(attributes: list[tuple[str, str]], group_by: list[str], sort: bool = True) -> Op:
    """AVERAGE, SUM, COUNT and CONCATENATION (sorted, joined by |) of columns, named `<column>_avg` and so on."""
    suffix = {"AVERAGE": "avg", "SUM": "sum", "COUNT": "count", "CONCATENATION": "concat"}

    def run(df: DataFrame) -> DataFrame:
        aggs: list[Column] = []
        for name, kind in attributes:
            c = name_of(df, name)
            if kind not in suffix:
                raise ValidationError(f"unknown aggregate {kind!r}")
            if kind in ("AVERAGE", "SUM") and not is_numeric(df, c):
                raise ValidationError(f"{c} is not numeric")
            if kind == "CONCATENATION" and not is_text(df, c):
                raise ValidationError(f"{c} is not a text column")
            made = F.concat_ws("|", F.sort_array(F.collect_list(col(c)))) if kind == "CONCATENATION" else function(suffix[kind])(col(c))
            aggs.append(made.alias(f"{c}_{suffix[kind]}"))
        groups = names_of(df, group_by)
        out = df.groupBy(*map(col, groups)).agg(*aggs)
        return out.orderBy(*map(col, groups)) if sort and not df.isStreaming else out

    return run


@operator("group_by")
def group_by(keys: list[str], values: list[str], functions: list[str], window: dict | None = None) -> Op:
    """Several keys and value columns, MIN/MAX/AVG/SUM/COUNT/MEDIAN each, optionally per time window
    ({key, length, slide?}), for batch and streams. Results are named `<function>_<column>`."""

    def run(df: DataFrame) -> DataFrame:
        groups: list[Column] = [col(k) for k in names_of(df, keys)]
        if window:
            groups.append(F.window(col(name_of(df, window["key"])), window["length"], window.get("slide") or window["length"]).alias("window"))
        return df.groupBy(*groups).agg(*(function(f)(col(v)).alias(f"{f.lower()}_{v}") for v in names_of(df, values) for f in functions))

    return run


@operator("time_window_aggregate")
def time_window_aggregate(length: str, time: str = "timestamp", columns: list[ColumnRef] | None = None, groups: list[ColumnRef] = (), agg: str = "avg") -> Op:
    """Tumbling windows of a time column with extra group columns and one function for all (numeric) columns."""

    def run(df: DataFrame) -> DataFrame:
        t, extra = name_of(df, time), names_of(df, groups)
        chosen = names_of(df, columns) if columns else [c for c in df.columns if is_numeric(df, c) and c not in extra]
        return df.groupBy(F.window(col(t), length).alias("window"), *map(col, extra)).agg(*(function(agg)(col(c)).alias(c) for c in chosen if c != t))

    return run


@operator("time_aggregate")
def time_aggregate(time: str, length: str, slide: str | None = None, agg: str = "AVERAGE") -> Op:
    """All other columns per tumbling or sliding window; the window's start takes the time column's name."""

    def run(df: DataFrame) -> DataFrame:
        t = name_of(df, time)
        out = df.groupBy(F.window(col(t), length, slide or length).alias("__w")).agg(*(function(agg)(col(c)).alias(c) for c in df.columns if c != t))
        return out.select(F.col("__w.start").alias(t), *(col(c) for c in df.columns if c != t))

    return run


@operator("pivot")
def pivot(group_by: list[ColumnRef], column: ColumnRef, value: ColumnRef, agg: str = "AVG", values: list | None = None, sort: bool = True) -> Op:
    """Groups by distinct values of a column. Give `values` to spare the job that finds them."""

    def run(df: DataFrame) -> DataFrame:
        groups = names_of(df, group_by)
        out = df.groupBy(*map(col, groups)).pivot(name_of(df, column), values).agg(function(agg)(col(name_of(df, value))))
        return out.orderBy(*map(col, groups)) if sort else out

    return run


@operator("transpose")
def transpose(column: ColumnRef, order_by: list[ColumnRef], most: int = 10_000) -> Op:
    """One column to a single row with columns `0`, `1`, ... in the declared order; refused beyond `most` rows."""

    def run(df: DataFrame) -> DataFrame:
        c = name_of(df, column)
        n = df.limit(most + 1).count()
        if n > most:
            raise ValidationError(f"more than {most} rows to transpose")
        rows = df.select(F.struct(*map(col, names_of(df, order_by))).alias("o"), col(c).alias("v"))
        line = rows.agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias("a"))
        return line.select(*(F.get("a", F.lit(i))["v"].alias(str(i)) for i in range(n)))

    return run


@operator("flatten_vectors")
def flatten_vectors(column: ColumnRef, order_by: list[ColumnRef], name: str | None = None, groups: list[ColumnRef] = ()) -> Op:
    """All vectors (or arrays) of a column end to end, in the declared order; one row, or one per group."""

    def run(df: DataFrame) -> DataFrame:
        c = name_of(df, column)
        value = col(c)
        if df.schema[c].dataType.typeName() == "vectorudt":
            from pyspark.ml.functions import vector_to_array

            value = vector_to_array(value)
        keyed = df.select(*map(col, names_of(df, groups)), F.struct(F.struct(*map(col, names_of(df, order_by))).alias("o"), value.alias("v")).alias("s"))
        whole = keyed.groupBy(*map(col, names_of(df, groups))).agg(F.array_sort(F.collect_list("s")).alias("a"))
        return whole.select(*map(col, names_of(df, groups)), F.flatten(F.transform("a", lambda x: x["v"])).alias(name or c))

    return run


@operator("frequency")
def frequency(columns: list[ColumnRef]) -> Op:
    """Each combination of values and how often it occurs, as `freq`."""
    return lambda df: df.groupBy(*map(col, names_of(df, columns))).agg(F.count("*").alias("freq"))


@operator("most_frequent")
def most_frequent(column: ColumnRef, least: bool = False) -> Op:
    """The most (or least) frequent value with its count; of equal counts the smallest value."""

    def run(df: DataFrame) -> DataFrame:
        c = name_of(df, column)
        counts = df.where(col(c).isNotNull()).groupBy(col(c)).agg(F.count("*").alias("freq"))
        return counts.orderBy(F.col("freq").asc() if least else F.col("freq").desc(), col(c)).limit(1)

    return run


@operator("statistics")
def statistics(column: ColumnRef) -> Op:
    """min, max, avg, std (sample) and count of a column in one pass, and its exact median by bucket counts."""

    def run(df: DataFrame) -> DataFrame:
        c = col(name_of(df, column))
        middle = F.lit(median_of(df, c)).cast("double")
        return df.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("avg"), F.stddev_samp(c).alias("std"), F.count(c).alias("count")).withColumn("median", middle)

    return run


@operator("column_means")
def column_means() -> Op:
    """The average of every numeric column, in one pass."""
    return lambda df: df.agg(*(F.avg(col(c)).alias(c) for c in df.columns if is_numeric(df, c)))


@operator("ensemble_aggregate")
def ensemble_aggregate(outputs: str, method: str, id_columns: list[ColumnRef]) -> Op:
    """Combine models' outputs element by element: `outputs` holds an array of texts like '[0.1 0.9]' or an
    array of arrays. SUM, AVG, MAX, MIN; AND and OR of non-zero elements as 1.0 or 0.0. Stays on the row: no shuffle."""

    def run(df: DataFrame) -> DataFrame:
        c = name_of(df, outputs)
        vectors = col(c)
        if df.schema[c].dataType.elementType.typeName() == "string":
            vectors = F.transform(vectors, lambda s: F.transform(F.filter(F.split(F.trim(F.translate(s, "[],", "   ")), "\\s+"), lambda x: x != ""), lambda x: x.try_cast("double")))
        width = F.array_max(F.transform(vectors, F.size))

        def combine(i: Column) -> Column:
            at = F.filter(F.transform(vectors, lambda v: F.get(v, i)), lambda x: x.isNotNull())
            total = F.aggregate(at, F.lit(0.0), lambda a, x: a + x)
            return {"SUM": total, "AVG": F.try_divide(total, F.size(at)), "MAX": F.array_max(at), "MIN": F.array_min(at), "AND": F.forall(at, lambda x: x != 0).cast("double"), "OR": F.exists(at, lambda x: x != 0).cast("double")}[method]

        made = F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), combine))
        return df.select(*map(col, names_of(df, id_columns)), made.alias("output"))

    return run


@operator("latest_per_key")
def latest_per_key(key: ColumnRef, offset: ColumnRef, value: ColumnRef) -> Op:
    """The value with the greatest offset of each key, e.g. the last message of a topic."""
    return lambda df: df.groupBy(col(name_of(df, key))).agg(F.max_by(col(name_of(df, value)), col(name_of(df, offset))).alias(name_of(df, value)))


@operator("session_window")
def session_window(keys: list[ColumnRef], time: ColumnRef, gap: str, values: list[ColumnRef] = (), agg: str = "SUM") -> Op:
    """Per key, periods of activity that end after `gap` without an event."""

    def run(df: DataFrame) -> DataFrame:
        w = F.session_window(col(name_of(df, time)), gap)
        out = df.groupBy(*map(col, names_of(df, keys)), w.alias("w")).agg(F.count("*").alias("events"), *(function(agg)(col(v)).alias(f"{agg.lower()}_{v}") for v in names_of(df, values)))
        return out.select(*map(col, names_of(df, keys)), F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", *(f"{agg.lower()}_{v}" for v in names_of(df, values)))

    return run


