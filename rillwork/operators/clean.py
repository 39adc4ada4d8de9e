"""Imputation, binning and scaling. Data-dependent constants come from one aggregate per operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import ColumnRef, col, is_numeric, is_text, names_of
from ..errors import ProcessError, ValidationError
from ..registry import Op, operator
from .ranks import median_of, values_at


@operator("impute")
def impute(method: str, columns: list[ColumnRef] | None = None, how: str = "ANY", numeric: float | None = None, text: str | None = None) -> Op:
    """IM drops rows with ANY or ALL nulls, SPECIFIC_VALUE fills constants, MEDIAN and MEAN fill numeric columns
    with the exact median or the mean of their values (types stay). All columns unless `columns` says which."""

    def run(df: DataFrame) -> DataFrame:
        chosen = names_of(df, columns) if columns is not None else df.columns
        if method == "IM":
            return df.na.drop(how.lower(), subset=chosen)
        if method == "SPECIFIC_VALUE":
            fill = {c: numeric for c in chosen if numeric is not None and is_numeric(df, c)} | {c: text for c in chosen if text is not None and is_text(df, c)}
            return df.na.fill(fill) if fill else df
        numbers = [c for c in chosen if is_numeric(df, c)]
        if not numbers:
            return df
        made = {c: median_of(df, col(c)) for c in numbers} if method == "MEDIAN" else df.agg(*(F.avg(col(c)).alias(c) for c in numbers)).first()
        return df.withColumns({c: F.coalesce(col(c), F.lit(made[c]).cast(df.schema[c].dataType)) for c in numbers})

    return run


def labels(value: Column, cuts: list[float]) -> Column:
    """'range1[-Infinity-5.000000]' and so on for left-closed bins between cuts; null stays null."""
    shown = lambda x: f"{x:.6f}"
    edges = ["-Infinity", *map(shown, cuts), "Infinity"]
    out = F.when(value.isNull() | F.isnan(value), F.lit(None))
    for i, cut in enumerate(cuts):
        out = out.when(value < cut, F.lit(f"range{i + 1}[{edges[i]}-{edges[i + 1]}]"))
    return out.otherwise(F.lit(f"range{len(cuts) + 1}[{edges[-2]}-{edges[-1]}]"))


def _binned(df: DataFrame, column: str, cuts: list[float], output: str) -> DataFrame:
    return df.withColumn(column if output == "VALUE_CHANGE" else f"{column}_result", labels(col(column).cast("double"), cuts))


@operator("equal_width_bins")
def equal_width_bins(columns: list[ColumnRef], bins: int, output: str = "NEW_COLUMN") -> Op:
    """k equal intervals between a column's least and greatest value; the outer ones are open."""
    if bins <= 1:
        raise ValidationError("at least two bins are needed")

    def run(df: DataFrame) -> DataFrame:
        chosen = names_of(df, columns)
        r = df.agg(*(x for c in chosen for x in (F.min(col(c).cast("double")).alias(f"lo_{c}"), F.max(col(c).cast("double")).alias(f"hi_{c}")))).first()
        for c in chosen:
            low, high = r[f"lo_{c}"], r[f"hi_{c}"]
            if low is None or high <= low:
                raise ValidationError(f"{c} has no range to be cut")
            df = _binned(df, c, [low + (high - low) / bins * i for i in range(1, bins)], output)
        return df

    return run


def depth_cuts(df: DataFrame, value: Column, bins: int) -> list[float]:
    """Cut points of bins of equal depth: the row count is cut into equal shares; a share ends after the value that
    completes it, so equal values stay together, and the cut lies midway to the next value.

    It is an error if some value holds so many rows that another share ends in it, as a bin would be empty."""
    ends = values_at(df, value, lambda n: [-(-n * i // bins) - 1 for i in range(1, bins)] if n >= bins else [])
    if len(set(ends)) < bins - 1:
        raise ProcessError(f"fewer than {bins} bins can be made without parting equal values")
    v = value.cast("double")
    following = df.where(~F.isnan(v)).agg(*(F.min(F.when(v > e, v)).alias(str(i)) for i, e in enumerate(ends))).first()
    if any(x is None for x in following):
        raise ProcessError(f"fewer than {bins} bins can be made without parting equal values")
    return [e + (x - e) / 2 for e, x in zip(ends, following, strict=True)]


@operator("equal_depth_bins")
def equal_depth_bins(columns: list[ColumnRef], bins: int, output: str = "NEW_COLUMN") -> Op:
    """Bins of about equally many rows that never part equal values (see `depth_cuts`), whatever the number of distinct values."""
    if bins <= 1:
        raise ValidationError("at least two bins are needed")

    def run(df: DataFrame) -> DataFrame:
        for c in names_of(df, columns):
            df = _binned(df, c, depth_cuts(df, col(c), bins), output)
        return df

    return run


@operator("minmax_scale")
def minmax_scale(columns: list[ColumnRef], low: float = 0.0, high: float = 1.0, real_min: float | None = None, real_max: float | None = None) -> Op:
    """Scale columns (texts are parsed) to [low, high], from their own range or a declared one; a constant column goes to the middle."""

    def run(df: DataFrame) -> DataFrame:
        chosen = names_of(df, columns)
        value = {c: col(c).try_cast("double") for c in chosen}
        if real_min is not None and real_max is not None:
            ends = {c: (real_min, real_max) for c in chosen}
        else:
            r = df.agg(*(x for c in chosen for x in (F.min(value[c]).alias(f"lo_{c}"), F.max(value[c]).alias(f"hi_{c}")))).first()
            ends = {c: (r[f"lo_{c}"], r[f"hi_{c}"]) for c in chosen}
        out = {}
        for c, (a, b) in ends.items():
            if a is None:
                out[c] = F.lit(None).cast("double")
            elif a == b:
                out[c] = F.when(value[c].isNotNull(), F.lit((low + high) / 2))
            else:
                out[c] = (value[c] - a) / (b - a) * (high - low) + low
        return df.withColumns(out)

    return run


