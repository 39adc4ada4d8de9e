"""Filters, group filters and top-k."""

from __future__ import annotations

import operator as ops

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import ColumnRef, col, name_of, names_of
from ..errors import ValidationError
from ..registry import Op, operator
from .project import numbered

_COMPARE = {"EQUAL": ops.eq, "LESS_THAN": ops.lt, "LARGE_THAN": ops.gt, "LESS_EQUAL": ops.le, "LARGE_EQUAL": ops.ge}


@operator("filter_rows")
def filter_rows(column: ColumnRef, condition: str = "EQUAL", value: float | None = None, pattern: str | None = None) -> Op:
    """Compare with a number, or test a text: EXIST contains `pattern`, LIKE matches it as a regular expression."""
    if condition not in (*_COMPARE, "EXIST", "LIKE"):
        raise ValidationError(f"unknown condition {condition!r}")

    def run(df: DataFrame) -> DataFrame:
        c = col(name_of(df, column))
        if condition == "EXIST":
            return df.where(c.contains(pattern))
        return df.where(c.rlike(pattern)) if condition == "LIKE" else df.where(_COMPARE[condition](c, F.lit(value)))

    return run


@operator("filter_sql")
def filter_sql(select: str = "*", where: str = "true", order_by: str = "") -> Op:
    """Clauses of one's own over the input; only to be given trusted text, as it is SQL."""

    def run(df: DataFrame) -> DataFrame:
        text = " ".join((f"select {select} from", "{df}", f"where {where}", f"order by {order_by}" if order_by else ""))
        return df.sparkSession.sql(text, df=df)

    return run


@operator("filter_groups")
def filter_groups(key: ColumnRef, condition: str, value: float, function: str = "COUNT", column: ColumnRef | None = None) -> Op:
    """Keep the rows of groups whose COUNT (or SUM of a column) satisfies the condition; null keys are a group.

    The groups that satisfy it are aggregated with map-side combine and semi-joined, so a hot
    key is never gathered in one task; Spark broadcasts the keys when they turn out small."""

    def run(df: DataFrame) -> DataFrame:
        k = name_of(df, key)
        measure = F.count("*") if function == "COUNT" else F.sum(col(name_of(df, column)))
        kept = df.groupBy(col(k).alias("__k")).agg(measure.alias("__m")).where(_COMPARE[condition](F.col("__m"), F.lit(value))).select("__k")
        return df.join(kept, col(k).eqNullSafe(F.col("__k")), "left_semi")

    return run


@operator("top_k")
def top_k(column: ColumnRef, n: int, ascending: bool = True, ties: list[ColumnRef] = ()) -> Op:
    """The first n rows by a column (then by `ties`): each task keeps n, no full sort."""

    def run(df: DataFrame) -> DataFrame:
        order = [col(c) for c in names_of(df, [column, *ties])]
        return df.orderBy(order[0].asc() if ascending else order[0].desc(), *order[1:]).limit(n)

    return run


@operator("order_by")
def order_by(column: ColumnRef, ascending: bool = True) -> Op:
    def run(df: DataFrame) -> DataFrame:
        c = col(name_of(df, column))
        return df.orderBy(c.asc() if ascending else c.desc())

    return run


@operator("drop_first")
def drop_first(n: int, order_by: list[ColumnRef]) -> Op:
    """Without the first n rows of a declared total order."""
    return lambda df: numbered(df, names_of(df, order_by), "__rn").where(F.col("__rn") > n).drop("__rn")


@operator("drop_last")
def drop_last(n: int, order_by: list[ColumnRef]) -> Op:
    """Without the last n rows of a declared total order."""
    return lambda df: numbered(df, names_of(df, order_by), "__rn", descending=True).where(F.col("__rn") > n).drop("__rn")


@operator("sample_simple")
def sample_simple(fraction: float, with_replacement: bool = False, seed: int = 0) -> Op:
    """Bernoulli or Poisson sampling; seed 0 draws anew each time."""
    return lambda df: df.sample(with_replacement, fraction, seed or None)


@operator("sample_stratified")
def sample_stratified(column: ColumnRef, fractions: dict, seed: int = 0) -> Op:
    """A fraction per key; keys that aren't named are left out."""
    return lambda df: df.sampleBy(name_of(df, column), fractions, seed or None)


@operator("set_operation")
def set_operation(kind: str) -> Op:
    """UNION_ALL, UNION, INTERSECT or EXCEPT of two tables with the same number of columns, by position."""

    def run(a: DataFrame, b: DataFrame) -> DataFrame:
        if len(a.columns) != len(b.columns):
            raise ValidationError("the tables differ in their number of columns")
        return {"UNION_ALL": lambda: a.union(b), "UNION": lambda: a.union(b).distinct(), "INTERSECT": lambda: a.intersect(b), "EXCEPT": lambda: a.subtract(b)}[kind]()

    return run
