"""Functions of one's own: scalar (Arrow batches), grouped aggregates and table functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def register_scalar(spark: SparkSession, name: str, function: Callable, returns: str, arrow: bool = True) -> Callable[..., Column]:
    """A Python function of single values, for SQL and DataFrames; Arrow transfers whole batches."""
    made = F.udf(function, returns, useArrow=arrow)
    spark.udf.register(name, made)
    return made


def register_pandas(spark: SparkSession, name: str, function: Callable, returns: str) -> Callable[..., Column]:
    """A function of pandas Series (its annotations say whether it maps or aggregates)."""
    made = F.pandas_udf(function, returns)
    spark.udf.register(name, made)
    return made


def register_table(spark: SparkSession, name: str, handler: type, returns: str) -> Callable:
    """A table function: a class with `eval` that yields rows."""
    made = F.udtf(handler, returnType=returns)
    spark.udtf.register(name, made)
    return made


def geometric_mean(v: pd.Series) -> float:
    """Grouped aggregate: the geometric mean of positive values, NaN without any."""
    import numpy as np

    v = v[v > 0]
    return float(np.exp(np.log(v).mean())) if len(v) else float("nan")


class SplitWords:
    """Table function: the words of a text with their positions."""

    def eval(self, text: str):
        for i, w in enumerate((text or "").split()):
            yield i, w


def route_lookup(index: Column, routes: dict[int, str]) -> Column:
    """The route of an index, null where there is none."""
    return F.element_at(F.create_map(*(x for k, v in routes.items() for x in (F.lit(k), F.lit(v)))), index)
