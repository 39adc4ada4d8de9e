"""Row windows: count-based sliding and tumbling windows over a declared order.

Rows are numbered exactly (project.numbered, no single-task sort); a window's members then follow
from the number alone, so windows need no further shuffle. With `groups`, windows run per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import ColumnRef, col, names_of
from ..errors import ValidationError
from ..registry import Op, operator
from .project import numbered


def _numbered(df: DataFrame, order: list[ColumnRef], groups: list[ColumnRef]) -> DataFrame:
    if groups:
        by = names_of(df, groups)
        # numbered over all groups at once, then shifted: a hot group is spread like any range of rows
        n = numbered(df, [*by, *names_of(df, order)], "__rn")
        ends = n.groupBy(*(col(c).alias(f"__g{i}") for i, c in enumerate(by))).agg(F.min("__rn").alias("__first"), F.count("*").alias("__n"))
        on = [col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)]
        return n.join(ends, on).withColumn("__rn", F.col("__rn") - F.col("__first") + 1)
    return numbered(df, names_of(df, order), "__rn").withColumn("__n", df.agg(F.count("*")).scalar())


@operator("sliding_rows")
def sliding_rows(size: int, order_by: list[ColumnRef], slide: int = 1, groups: list[ColumnRef] = ()) -> Op:
    """Rows [i, i + size) for i = 0, slide, 2*slide, ... as long as the window is full, with `window_id` (from 0).

    Fewer than `size` rows give no window. Each row is copied into the windows it belongs to."""
    if size < 1 or slide < 1:
        raise ValidationError("size and slide must be positive")

    def run(df: DataFrame) -> DataFrame:
        n = _numbered(df, order_by, groups)
        at = F.col("__rn") - 1
        first = F.greatest(F.ceil((at - size + 1) / slide), F.lit(0))
        last = F.least(F.floor(at / slide), F.floor((F.col("__n") - size) / slide))
        spread = n.where((F.col("__n") >= size) & (first <= last)).withColumn("window_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        return spread.select("window_id", *map(col, df.columns))

    return run


@operator("tumbling_rows")
def tumbling_rows(size: int, order_by: list[ColumnRef], groups: list[ColumnRef] = (), keep_rest: bool = True) -> Op:
    """Consecutive windows of `size` rows with `window_id`; the last one may be shorter, or is left out."""
    if size < 1:
        raise ValidationError("size must be positive")

    def run(df: DataFrame) -> DataFrame:
        n = _numbered(df, order_by, groups).withColumn("window_id", F.floor((F.col("__rn") - 1) / size))
        if not keep_rest:
            n = n.where((F.col("window_id") + 1) * size <= F.col("__n"))
        return n.select("window_id", *map(col, df.columns))

    return run
