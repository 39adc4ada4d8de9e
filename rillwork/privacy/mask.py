"""Masking: bucket statistics, ranges, rounding, blanks, generalisation, dropping.

Bucket bounds come from one aggregate; statistics per bucket are one small aggregate that is
joined back, so no window gathers a bucket's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import ColumnRef, col, is_numeric, name_of, names_of
from ..errors import ValidationError
from ..registry import Op, operator
from .fields import SAFE_HARBOR, FieldSpec, Role, with_role

STATISTICS = {"MIN": F.min, "MAX": F.max, "AVG": F.avg, "STD": F.stddev_samp, "COUNT": F.count}
#: Fixed value: a number inside a text.
EMBEDDED = "^([^0-9]*)([0-9]+)([^0-9]*)$"


def bounds(df: DataFrame, value: Column) -> tuple[float, float] | None:
    r = df.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    return None if r.a is None else (float(r.a), float(r.b))


def step_of(low: float, high: float, buckets: int) -> float:
    return (high - low) / buckets if high > low else 1.0


def bucket(value: Column, low: float, high: float, buckets: int, last: int) -> Column:
    """Number of a value's bucket, null for null; buckets from `last` on are one."""
    return F.when(value.isNotNull(), F.least(F.floor((value - low) / step_of(low, high, buckets)), F.lit(last)).cast("int"))


def embedded(c: Column) -> Column:
    """The one number inside a text, or null."""
    return F.regexp_extract(c, EMBEDDED, 2).try_cast("double")


def around(c: Column, middle: Column) -> Column:
    """A text with its number replaced; texts without exactly one number stay."""
    return F.when(c.rlike(EMBEDDED) & middle.isNotNull(), F.concat(F.regexp_extract(c, EMBEDDED, 1), middle, F.regexp_extract(c, EMBEDDED, 3))).otherwise(c)


def is_pure_text(df: DataFrame, c: str) -> bool:
    """Whether any value of a column lacks a digit."""
    return bool(df.agg(F.bool_or(~col(c).rlike("[0-9]"))).first()[0])


def _by_bucket(df: DataFrame, c: str, value: Column, buckets: int, method: str) -> DataFrame:
    """`df` with `__v`, the statistic of the value's bucket. The greatest value has a bucket of its own."""
    ends = bounds(df, value)
    if ends is None:
        return df.withColumn("__v", F.lit(None).cast("string"))
    marked = df.withColumn("__b", bucket(value, *ends, buckets, buckets))
    table = marked.where("__b is not null").groupBy("__b").agg(STATISTICS[method](value).cast("string").alias("__v"))
    # at most buckets + 1 rows
    return marked.join(F.broadcast(table), "__b", "left").drop("__b")


@operator("mask_aggregate")
def mask_aggregate(columns: list[ColumnRef], method: str = "AVG", buckets: int = 10) -> Op:
    """Numbers to the statistic of their bucket (equal widths between least and greatest); texts as mask_hide."""

    def run(df: DataFrame) -> DataFrame:
        for c in names_of(df, columns):
            if is_numeric(df, c):
                order = df.columns
                df = _by_bucket(df, c, col(c).cast("double"), buckets, method).withColumn(c, F.col("__v")).select(*map(col, order))
            else:
                df = mask_hide([c], method, buckets=buckets)(df)
        return df

    return run


@operator("mask_range")
def mask_range(columns: list[ColumnRef], buckets: int = 10) -> Op:
    """Numbers, or the number inside a text, to `[low,high]` of their bucket, whole numbers. Pure expressions after one aggregate."""

    def run(df: DataFrame) -> DataFrame:
        for c in names_of(df, columns):
            value = col(c).cast("double") if is_numeric(df, c) else embedded(col(c))
            ends = bounds(df, value)
            if ends is None:
                continue
            step, b = step_of(*ends, buckets), bucket(value, *ends, buckets, buckets)
            shown = F.concat(F.lit("["), (F.lit(ends[0]) + b * step).cast("long").cast("string"), F.lit(","), (F.lit(ends[0]) + (b + 1) * step).cast("long").cast("string"), F.lit("]"))
            df = df.withColumn(c, shown if is_numeric(df, c) else around(col(c), shown))
        return df

    return run


def rounded(value: Column, step: int, method: str) -> Column:
    """A number, cut to a whole one first, to a multiple of `step`."""
    whole = value.cast("long")
    rest = whole % step
    down, up = whole - rest, F.when(rest == 0, whole).otherwise(whole - rest + step)
    if method == "ROUND_UP":
        return up
    return down if method == "ROUND_DOWN" else F.when(value % step >= step / 2, whole - rest + step).otherwise(down)


@operator("mask_round")
def mask_round(columns: list[ColumnRef], step: int = 10, method: str = "ROUND") -> Op:
    """Numbers, or the number inside a text, to multiples of `step`: ROUND, ROUND_UP or ROUND_DOWN."""
    if step < 1 or method not in ("ROUND", "ROUND_UP", "ROUND_DOWN"):
        raise ValidationError("step must be positive and the method ROUND, ROUND_UP or ROUND_DOWN")

    def run(df: DataFrame) -> DataFrame:
        change = {}
        for c in names_of(df, columns):
            if is_numeric(df, c):
                change[c] = rounded(col(c), step, method)
            else:
                change[c] = around(col(c), rounded(embedded(col(c)), step, method).cast("double").cast("string"))
        return df.withColumns(change)

    return run


@operator("mask_hide")
def mask_hide(columns: list[ColumnRef], method: str = "AVG", data_range: bool = False, buckets: int = 10) -> Op:
    """A data range; or bucket statistics for numbers and for numbers inside texts; pure texts: rare values are starred."""

    def run(df: DataFrame) -> DataFrame:
        from .suppress import reduce_records

        for c in names_of(df, columns):
            order = df.columns
            if data_range:
                df = mask_range([c], buckets)(df)
            elif is_numeric(df, c):
                df = mask_aggregate([c], method, buckets)(df)
            elif is_pure_text(df, c):
                df = reduce_records([c])(df)
            else:
                df = _by_bucket(df, c, embedded(col(c)), buckets, method).withColumn(c, around(col(c), F.col("__v"))).select(*map(col, order))
        return df

    return run


FILL = {"BLANK": " ", "STAR": "*", "UNDERBAR": "_"}


@operator("mask_blank")
def mask_blank(columns: list[ColumnRef], positions: list[int], count: int = 1, method: str = "STAR") -> Op:
    """Replace `count` characters from each position (0: to the end) by blanks, stars or underbars; positions beyond the end change nothing."""

    def run(df: DataFrame) -> DataFrame:
        change = {}
        for c in names_of(df, columns):
            text = col(c).cast("string")
            for p in positions:
                n = F.length(text) - p
                n = n if count == 0 else F.least(n, F.lit(count))
                text = F.when(F.length(text) > p, F.concat(F.substring(text, 1, p), F.repeat(F.lit(FILL[method]), n), F.substr(text, F.lit(p + 1) + n, F.length(text)))).otherwise(text)
            change[c] = text
        return df.withColumns(change)

    return run


def generalised(df: DataFrame, c: str, levels: int, level: int, top: float | None = None) -> Column:
    """A column at a level of 0 (as it is) to `levels` (fully general): texts lose a share of their end and get `*`;
    numbers become `low~high`, as wide as greatest / 2^levels * 2^level."""
    if level == 0:
        return col(c).cast("string")
    if not is_numeric(df, c):
        cut = F.floor(F.length(col(c)).cast("double") / levels * level).cast("int")
        return F.concat(F.substr(col(c), F.lit(1), F.length(col(c)) - cut), F.lit("*"))
    top = top if top is not None else df.agg(F.max(col(c))).first()[0]
    width = float(top or 0) / 2**levels * 2**level
    at = F.try_divide(col(c).cast("double"), F.lit(width)).cast("long")
    return F.concat((at * width).cast("string"), F.lit("~"), ((at + 1) * width).cast("string"))


@operator("generalize")
def generalize(columns: list[tuple[ColumnRef, int, int]]) -> Op:
    """(column, levels, level) each, see `generalised`. One aggregate for all numeric maxima."""

    def run(df: DataFrame) -> DataFrame:
        named = [(name_of(df, c), n, k) for c, n, k in columns]
        numbers = [c for c, _, _ in named if is_numeric(df, c)]
        top = df.agg(*(F.max(col(c)).alias(c) for c in numbers)).first() if numbers else {}
        return df.withColumns({c: generalised(df, c, n, k, float(top[c] or 0) if c in numbers else None) for c, n, k in named})

    return run


@operator("hierarchy")
def hierarchy(column: ColumnRef, levels: int = 5) -> Op:
    """The generalisation table of a column's distinct values: `level0` to `level<levels>`."""

    def run(df: DataFrame) -> DataFrame:
        c = name_of(df, column)
        top = df.agg(F.max(col(c))).first()[0] if is_numeric(df, c) else None
        return df.select(col(c)).where(col(c).isNotNull()).distinct().select(*(generalised(df, c, levels, k, float(top or 0) if top is not None else None).alias(f"level{k}") for k in range(levels + 1)))

    return run


def lattice(depths: dict[str, int]) -> list[tuple[dict[str, int], float]]:
    """All combinations of levels with their mean relative height, lowest first."""
    import itertools

    names = sorted(depths)
    nodes = [dict(zip(names, levels, strict=True)) for levels in itertools.product(*(range(depths[n] + 1) for n in names))]
    return sorted(((n, sum(n[c] / depths[c] for c in names if depths[c]) / max(len(names), 1)) for n in nodes), key=lambda x: (x[1], tuple(x[0].values())))


@operator("drop_identifiers")
def drop_identifiers(fields: list[FieldSpec] = (), columns: list[ColumnRef] | None = None) -> Op:
    """Without the identifier columns, or the selected ones."""
    return lambda df: df.drop(*(names_of(df, columns) if columns is not None else with_role(list(fields), Role.IDENTIFIER, df)))


@operator("drop_quasi_identifiers")
def drop_quasi_identifiers(fields: list[FieldSpec], names: list[str] = ()) -> Op:
    """Without quasi-identifiers whose name contains, or is contained in, a safe-harbour name or one of `names`."""

    def listed(c: str) -> bool:
        return any(a.lower() in c.lower() or c.lower() in a.lower() for a in (*SAFE_HARBOR, *names))

    return lambda df: df.drop(*(c for c in with_role(list(fields), Role.QUASIIDENTIFIER, df) if listed(c)))


