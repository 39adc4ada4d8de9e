"""Operators by name. An operator is made from parameters and maps DataFrames to a DataFrame.

    @operator("top_k")
    def top_k(column, n, ascending=True): return lambda df: ...

`build("top_k", column="x", n=3)` makes one; the same object serves batch and streaming.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from .errors import ProcessError, ValidationError

Op = Callable[..., DataFrame]
_OPERATORS: dict[str, Callable[..., Op]] = {}
_BUILT_IN = ("operators.project", "operators.filters", "operators.joins", "operators.aggregate", "operators.rows", "operators.clean", "operators.timeseries", "operators.features", "operators.learn", "privacy.mask", "privacy.perturb", "privacy.suppress", "streaming.windows")


def operator(name: str) -> Callable[[Callable[..., Op]], Callable[..., Op]]:
    """Register a maker of operators; also the plug-in point for operators of one's own."""

    def register(maker: Callable[..., Op]) -> Callable[..., Op]:
        if name in _OPERATORS and _OPERATORS[name].__module__ != maker.__module__:
            raise ValidationError(f"operator {name!r} is registered twice")
        _OPERATORS[name] = maker
        return maker

    return register


def operators() -> dict[str, Callable[..., Op]]:
    for module in _BUILT_IN:
        importlib.import_module(f"rillwork.{module}")
    return dict(_OPERATORS)


def build(name: str, *, strict: bool = True, **params: object) -> Op:
    """An operator by name. With strict=False, one that can't be planned returns its first input unchanged."""
    known = operators()
    if name not in known:
        raise ValidationError(f"unknown operator {name!r}")
    op = known[name](**params)

    def run(*dfs: DataFrame) -> DataFrame:
        try:
            return op(*dfs)
        except ValidationError:
            if strict:
                raise
        except AnalysisException as e:
            if strict:
                raise ProcessError(f"{name}: {e}") from e
        return dfs[0]

    return run
