"""Operators that only make sense on streams: watermarks and per-key count windows.

All other operators take streaming DataFrames as they are."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..columns import ColumnRef, col, name_of, names_of
from ..errors import ValidationError
from ..registry import Op, operator


@operator("watermark")
def watermark(time: ColumnRef, delay: str) -> Op:
    """A watermark on a time column, which is cast to a timestamp with zone if it has none."""

    def run(df: DataFrame) -> DataFrame:
        t = name_of(df, time)
        if df.schema[t].dataType != T.TimestampType():
            df = df.withColumn(t, col(t).cast("timestamp"))
        return df.withWatermark(t, delay)

    return run


@operator("count_windows")
def count_windows(keys: list[ColumnRef], order_by: list[ColumnRef], size: int, slide: int = 1) -> Op:
    """Per key, windows of `size` rows that move by `slide`, emitted once full, with `window_id` (from 0) per key.

    State: the rows since the current window's start, at most `size` - 1 of them plus `slide` to be skipped. Rows of a
    micro-batch are taken in the declared order; what arrives in later batches comes later."""
    if size < 1 or slide < 1:
        raise ValidationError("size and slide must be positive")

    def run(df: DataFrame) -> DataFrame:
        by, order = names_of(df, keys), names_of(df, order_by)
        rows = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
        out = T.StructType([T.StructField("window_id", T.LongType()), *rows.fields])
        held = T.StructType([T.StructField("next_id", T.LongType()), T.StructField("skip", T.LongType()), T.StructField("rows", T.StringType())])

        def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            import base64
            import pickle

            next_id, skip, kept = state.get if state.exists else (0, 0, "")
            fresh = pd.concat(list(frames)).sort_values(order, kind="stable")
            old = pickle.loads(base64.b64decode(kept)) if kept else fresh.iloc[:0]  # written by this operator itself
            rows = pd.concat([old, fresh], ignore_index=True) if len(old) else fresh.reset_index(drop=True)
            gone = min(skip, len(rows))
            rows, skip = rows.iloc[gone:], skip - gone
            at = 0
            while skip == 0 and len(rows) - at >= size:
                yield rows.iloc[at : at + size].assign(window_id=next_id)[["window_id", *rows.columns]]
                next_id += 1
                at += slide
                if at > len(rows):
                    skip, at = at - len(rows), len(rows)
            state.update((next_id, skip, base64.b64encode(pickle.dumps(rows.iloc[at:])).decode()))

        return df.groupBy(*map(col, by)).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.NoTimeout)

    return run


@operator("latest_messages")
def latest_messages(topic: str = "topic", offset: str = "offset", value: str = "value") -> Op:
    return lambda df: df.groupBy(topic).agg(F.max_by(col(value).cast("string"), col(offset)).alias(value))
