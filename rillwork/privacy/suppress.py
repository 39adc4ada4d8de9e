"""Suppression of outliers and of small equivalence classes. Class sizes are small aggregates that
are joined back, so a class that holds a third of the rows costs no task more than its share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import ColumnRef, col, is_numeric, names_of
from ..registry import Op, operator
from .mask import FILL, STATISTICS, bounds, bucket

#: How far from the middle an outlier is.
BOX, SIGMA = 0.5, 1.5


def _limits(value: Column, method: str) -> tuple[Column, Column]:
    if method == "BOXPLOT":
        q1, q3 = F.percentile(value, 0.25), F.percentile(value, 0.75)
        return q1 - (q3 - q1) * BOX, q3 + (q3 - q1) * BOX
    spread = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return F.avg(value) - spread * SIGMA, F.avg(value) + spread * SIGMA


def outliers(df: DataFrame, c: str, buckets: int, method: str, statistic: str = "AVG") -> DataFrame:
    """`df` with `__out` (outside the limits of its bucket) and `__v` (the bucket's statistic). Exact quantiles."""
    value = col(c).cast("double")
    ends = bounds(df, value)
    if ends is None:
        return df.withColumns({"__out": F.lit(False), "__v": F.lit(None).cast("double")})
    marked = df.withColumn("__b", bucket(value, *ends, buckets, buckets - 1))
    low, high = _limits(value, method)
    table = marked.where("__b is not null").groupBy("__b").agg(low.alias("__lo"), high.alias("__hi"), STATISTICS[statistic](value).alias("__v"))
    return marked.join(F.broadcast(table), "__b", "left").withColumn("__out", F.coalesce((value < F.col("__lo")) | (value > F.col("__hi")), F.lit(False))).drop("__b", "__lo", "__hi")


def rare_values(df: DataFrame, columns: list[str], method: str) -> tuple[DataFrame, DataFrame]:
    """(frequency table, its rows that are rare): fewer than mean - 1.5 sigma (population) or Q1 - 0.5 IQR of the counts."""
    table = df.groupBy(*map(col, columns)).agg(F.count("*").alias("__n"))
    n = F.col("__n").cast("double")
    if method == "BOXPLOT":
        low = F.percentile(n, 0.25) - (F.percentile(n, 0.75) - F.percentile(n, 0.25)) * BOX
    else:
        low = F.avg(n) - F.stddev_pop(n) * SIGMA
    limit = table.agg(low.alias("l")).first().l
    return table, table.where(n < F.lit(limit)) if limit is not None else table.limit(0)


def _mark(df: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """`df` with `__hit`: whether its values are among the keys; nulls equal nulls."""
    keys = keys.select(*(col(c).alias(f"__k{i}") for i, c in enumerate(columns)), F.lit(True).alias("__hit"))
    on = [col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(columns)]
    return df.join(keys, on, "left").drop(*(f"__k{i}" for i in range(len(columns)))).withColumn("__hit", F.coalesce("__hit", F.lit(False)))


@operator("mask_outliers")
def mask_outliers(columns: list[ColumnRef], statistic: str = "AVG", method: str = "ZSCORE", buckets: int = 10) -> Op:
    """Numeric outliers inside each bucket to the bucket's statistic; rare texts to the most frequent one."""

    def run(df: DataFrame) -> DataFrame:
        for c in names_of(df, columns):
            order = df.columns
            if is_numeric(df, c):
                df = outliers(df, c, buckets, method, statistic).withColumn(c, F.when(F.col("__out"), F.col("__v")).otherwise(col(c).cast("double")))
            else:
                table, rare = rare_values(df, [c], method)
                top = table.orderBy(F.desc("__n"), col(c)).first()
                df = _mark(df, [c], rare).withColumn(c, F.when(F.col("__hit"), F.lit(top[c] if top else None)).otherwise(col(c)))
            df = df.select(*map(col, order))
        return df

    return run


@operator("reduce_records")
def reduce_records(columns: list[ColumnRef], fill: str = "STAR", together: bool = False, method: str = "ZSCORE") -> Op:
    """Outlying cells (numbers: bounds of the whole column, texts: rare values) to `*`, blank or `_`; with
    `together`, the cells of rows whose combination of values is rare."""

    def run(df: DataFrame) -> DataFrame:
        chosen, order = names_of(df, columns), df.columns
        if together:
            _, rare = rare_values(df, chosen, method)
            return _mark(df, chosen, rare).withColumns({c: F.when(F.col("__hit"), F.lit(FILL[fill])).otherwise(col(c).cast("string")) for c in chosen}).select(*map(col, order))
        for c in chosen:
            if is_numeric(df, c):
                df = outliers(df, c, 1, method).withColumn(c, F.when(F.col("__out"), F.lit(FILL[fill])).otherwise(col(c).cast("string")))
            else:
                _, rare = rare_values(df, [c], method)
                df = _mark(df, [c], rare).withColumn(c, F.when(F.col("__hit"), F.lit(FILL[fill])).otherwise(col(c)))
            df = df.select(*map(col, order))
        return df

    return run


@operator("equivalence_classes")
def equivalence_classes(columns: list[ColumnRef]) -> Op:
    """Each combination of quasi-identifiers with its size `class_size`."""
    return lambda df: df.groupBy(*map(col, names_of(df, columns))).agg(F.count("*").alias("class_size"))


@operator("suppress_small_classes")
def suppress_small_classes(columns: list[ColumnRef], k: int | None = None, risk: float | None = None, ratio: float | None = None, fill: str = "*") -> Op:
    """Star the quasi-identifiers of classes smaller than k (or riskier than `risk`, i.e. 1/size above it). With `ratio`,
    smallest classes first as long as no more than that share of all rows is suppressed."""

    def run(df: DataFrame) -> DataFrame:
        chosen, order = names_of(df, columns), df.columns
        sizes = df.groupBy(*map(col, chosen)).agg(F.count("*").alias("__n"))
        small = sizes.where(F.col("__n") < k) if k is not None else sizes.where(F.lit(1.0) / F.col("__n") > F.lit(risk))
        if ratio is not None:
            from ..operators.project import numbered

            total = df.count()
            # classes of equal size stand in the order of their values; the running sum follows the class sizes only
            ranked = numbered(small, ["__n", *chosen], "__rk")
            per = ranked.groupBy("__n").agg(F.count("*").alias("c"), F.min("__rk").alias("f"))
            from pyspark.sql import Window

            upto = per.withColumn("before", F.coalesce(F.sum(F.col("c") * F.col("__n")).over(Window.orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("__n").alias("__m"), "f", "before")
            small = ranked.join(F.broadcast(upto), F.col("__n") == F.col("__m")).where(F.col("before") + (F.col("__rk") - F.col("f") + 1) * F.col("__n") <= total * ratio)
        return _mark(df, chosen, small).withColumns({c: F.when(F.col("__hit"), F.lit(fill)).otherwise(col(c).cast("string")) for c in chosen}).select(*map(col, order))

    return run
