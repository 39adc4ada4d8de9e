"""Joins, positional merging and as-of joins. Strategies are left to Catalyst and AQE;
`broadcast_join` hints only after checking the size of the side it sends."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ColumnRef, col, name_of, names_of
from ..errors import ValidationError
from ..registry import Op, operator
from ..session import is_small
from .project import numbered

_KINDS = {"INNER": "inner", "LEFT_OUTER": "left", "RIGHT_OUTER": "right", "FULL_OUTER": "full", "LEFT_SEMI": "left_semi", "LEFT_ANTI": "left_anti"}


@operator("join_on_key")
def join_on_key(key: str, columns: list[list[ColumnRef]] | None = None, kind: str = "INNER") -> Op:
    """Join any number of tables on one key, each cut to the key and its own `columns` (all if none are given)."""

    def run(*dfs: DataFrame) -> DataFrame:
        parts = list(dfs)
        if columns:
            parts = [df.select(*map(col, dict.fromkeys([name_of(df, key), *names_of(df, cs)]))) for df, cs in zip(dfs, columns, strict=True)]
        return reduce(lambda a, b: a.join(b, key, _KINDS[kind]), parts)

    return run


@operator("join_columns")
def join_columns(pairs: list[tuple[str, str]], kind: str = "INNER") -> Op:
    """Join two tables on pairs of differently named keys; both sides' columns stay (their names must differ)."""

    def run(a: DataFrame, b: DataFrame) -> DataFrame:
        on = reduce(lambda x, y: x & y, (a[p] == b[q] for p, q in pairs))
        return a.join(b, on, _KINDS[kind])

    return run


@operator("broadcast_join")
def broadcast_join(pairs: list[tuple[str, str]], kind: str = "INNER", most_rows: int = 100_000) -> Op:
    """As join_columns; the right side is broadcast if it has at most `most_rows` rows, else joined by shuffle."""

    def run(a: DataFrame, b: DataFrame) -> DataFrame:
        return join_columns(pairs, kind)(a, F.broadcast(b) if is_small(b, most_rows) else b)

    return run


@operator("join_interval")
def join_interval(key: str, time: str, within: str = "1 minutes", kind: str = "INNER") -> Op:
    """left.key = right.key and right.time <= left.time <= right.time + within; left-deep over the inputs.

    The right sides' key and time are dropped. On streams, both sides need watermarks. In batch, inner and left
    joins also match on time buckets as wide as `within` (a right row is copied into two), so that the
    rows of a hot key meet only those near them."""
    width = _seconds(within)

    def pair(a: DataFrame, b: DataFrame) -> DataFrame:
        clash = [c for c in b.columns if c in a.columns and c not in (key, time)]
        b = b.withColumnsRenamed({key: "__key", time: "__time"} | {c: f"{c}_right" for c in clash})
        on = f"`{key}` = __key and `{time}` >= __time and `{time}` <= __time + interval {within}"
        if width and kind in ("INNER", "LEFT_OUTER") and not (a.isStreaming or b.isStreaming):
            at = lambda c: F.floor(F.unix_timestamp(col(c).cast("timestamp")) / width)
            a = a.withColumn("__near", at(time))
            b = b.withColumn("__slot", F.explode(F.array(at("__time"), at("__time") + 1)))
            on += " and __near = __slot"
        return a.join(b, F.expr(on), _KINDS[kind]).drop("__key", "__time", "__near", "__slot")

    return lambda *dfs: reduce(pair, dfs)


def _seconds(within: str) -> int | None:
    """Whole seconds of texts like '5 minutes', None for other intervals."""
    m = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day)s?\s*", within, re.I)
    return int(m[1]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[m[2].lower()] or None if m else None


#: Bucket widths of a range join, as the left side is copied for each. Steps of ranges that are one value, and of those without an end.
MOST_WIDTHS, EQUAL, OPEN = 6, 5_000, -5_000


def _merged(seen: dict[int, int], most: int = MOST_WIDTHS) -> list[int]:
    """The steps to use: rare ones are given up for the next wider one, which costs them twice the candidates per step between."""
    seen = dict(seen)
    while len(seen) > most:
        order = sorted(seen)
        wider, n = min(zip(order, order[1:], strict=False), key=lambda x: seen[x[1]] * 2.0 ** min(x[1] - x[0], 900))
        seen[wider] += seen.pop(n)
    return sorted(seen)


@operator("join_range")
def join_range(key: str | None, value: str, low: str, high: str, width: float) -> Op:
    """Rows of the left whose `value` lies within [low, high] of the right (with an equal `key`, if one is given).

    Buckets make it an equi-join: a range is copied into the buckets it touches. Their `width` is halved or doubled until it
    fits a range's length (counted first), so that a range meets few rows beside its own, and is copied into two or three;
    where lengths differ, the left side is copied for each width. Streams keep `width`."""
    number = lambda c: col(c).cast("double")

    def at(c: str, n: int) -> Column:
        if n in (EQUAL, OPEN):
            return number(c) if n == EQUAL else F.lit(0.0)
        return F.floor(number(c) / math.ldexp(width, -n))

    def span(n: int) -> Column:
        return F.array(at(low, n)) if n in (EQUAL, OPEN) else F.sequence(at(low, n), at(high, n)).cast("array<double>")

    def run(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.where(col(low) <= col(high))
        length = number(high) - number(low)
        fit = F.floor(F.log2(F.lit(float(width))) - F.log2(F.greatest(length, F.lit(1e-300)))).cast("int")
        step = F.when(length == 0, EQUAL).when(length < 1e300, fit).otherwise(OPEN)
        streams = a.isStreaming or b.isStreaming
        steps = [0] if streams else _merged({r[0]: r[1] for r in b.groupBy(step).count().collect()}) or [0]
        chosen = lambda of: F.coalesce(*(F.when(F.col("__n") == n, of(n)) for n in steps))
        left = a.withColumn("__n", F.explode(F.array(*map(F.lit, steps)))).withColumn("__b", chosen(lambda n: at(value, n).cast("double")))
        right = b.withColumn("__n", F.coalesce(*(F.when(step >= n, n) for n in reversed(steps)), F.lit(steps[0]))).withColumn("__b", F.explode(chosen(span)))
        keys = ["__b", "__n", key] if key else ["__b", "__n"]
        return left.join(right, keys).where((col(value) >= col(low)) & (col(value) <= col(high))).drop("__b", "__n")

    return run


@operator("join_asof")
def join_asof(key: str, time: str, right_columns: list[str], segment: str | float = "day") -> Op:
    """Each left row with the right side's latest row of its key at or before its time; null where there is none.

    Union and windows, no join of rows. Windows run per key and segment of time (a unit of date_trunc, or a width
    for numbers); the latest right row before each segment is carried in, so a hot key is spread over
    its segments. Ties on the right: the greatest tuple of columns. Null keys match nothing."""

    def run(a: DataFrame, b: DataFrame) -> DataFrame:
        payload = F.struct(col(time).alias("__t"), *[col(c).alias(c) for c in right_columns])
        whole = F.struct(*map(col, a.columns))
        kind = b.select(payload).schema[0].dataType
        part = F.floor(F.col("__t") / segment) if isinstance(segment, int | float) else F.date_trunc(segment, F.col("__t"))
        left = a.select(col(key).alias("__k"), col(time).alias("__t"), whole.alias("__l"), F.lit(None).cast(kind).alias("__r"), F.lit(1).alias("__o"))
        right = b.where(col(key).isNotNull() & col(time).isNotNull()).select(col(key).alias("__k"), col(time).alias("__t"), F.lit(None).cast(a.select(whole).schema[0].dataType).alias("__l"), payload.alias("__r"), F.lit(0).alias("__o"))
        rows = left.unionByName(right).withColumn("__s", part)
        lasts = rows.groupBy("__k", "__s").agg(F.max("__r").alias("__r"))
        before = Window.partitionBy("__k").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
        carried = lasts.select(F.col("__k").alias("__ck"), F.col("__s").alias("__cs"), F.last("__r", True).over(before).alias("__c"))
        w = Window.partitionBy("__k", "__s").orderBy("__t", "__o", "__r").rowsBetween(Window.unboundedPreceding, 0)
        near = rows.withColumn("__m", F.last("__r", True).over(w)).where("__o = 1")
        out = near.join(carried, (F.col("__k") == F.col("__ck")) & (F.col("__s") == F.col("__cs")), "left").withColumn("__m", F.when(F.col("__k").isNotNull() & F.col("__t").isNotNull(), F.coalesce("__m", "__c")))
        return out.select("__l.*", *(F.col(f"__m.`{c}`").alias(c if c not in a.columns else f"{c}_right") for c in right_columns))

    return run


@operator("append_columns")
def append_columns(order_by: list[list[ColumnRef]]) -> Op:
    """Tables side by side, matched by position in each table's declared total order; they must have equally many rows,
    else the shorter one is filled with nulls. Clashing names get the suffix `_2`, `_3`, ..."""

    def run(*dfs: DataFrame) -> DataFrame:
        out = numbered(dfs[0], names_of(dfs[0], order_by[0]), "__rn")
        for i, df in enumerate(dfs[1:], 2):
            df = df.withColumnsRenamed({c: f"{c}_{i}" for c in df.columns if c in out.columns})
            order = [c if c in df.columns else f"{c}_{i}" for c in names_of(dfs[i - 1], order_by[i - 1])]
            out = out.join(numbered(df, order, "__rn"), "__rn", "full")
        return out.drop("__rn")

    return run


@operator("merge_tables")
def merge_tables(kinds: list[str], key: str = "TIMESTAMP", order_by: list[list[ColumnRef]] | None = None) -> Op:
    """Fold tables from the left: CONCAT (union all), INNER_JOIN and OUTER_JOIN (left) on `key`, APPEND (side by side)."""

    def run(*dfs: DataFrame) -> DataFrame:
        out = dfs[0]
        for i, (kind, df) in enumerate(zip(kinds, dfs[1:], strict=True), 1):
            if kind == "CONCAT":
                if len(out.columns) != len(df.columns):
                    raise ValidationError("the tables differ in their number of columns")
                out = out.union(df)
            elif kind in ("INNER_JOIN", "OUTER_JOIN"):
                out = out.join(df, key, "inner" if kind == "INNER_JOIN" else "left")
            elif kind == "APPEND":
                out = append_columns([(order_by or [[]] * (i + 1))[0], (order_by or [[]] * (i + 1))[i]])(out, df)
            else:
                raise ValidationError(f"unknown merge {kind!r}")
        return out

    return run
