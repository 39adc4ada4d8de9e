"""Ordered series per source, split so that no task ever holds a whole hot source.

`split_hot` tells sources of more than `hot_rows` rows from others, and `cut_series` cuts series
into chunks by rank. The rank is exact and never needs the whole series in one task:
rows are counted per time unit, the counts are summed before each unit, and rows are
numbered inside their unit only. Rows near a cut are copied into the neighbouring chunk
as halo. `whole_series` then hands Python workers Arrow tables that hold whole chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CORE, HALO, HEADER = 0, 1, 2


def split_hot(df: DataFrame, key: str, hot_rows: int, most: int = 5_000) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(other rows, rows of hot keys, (key, n) of the hot keys); the latter two are None where no key is hot.

    One job counts rows per key, combined on the map side. Up to `most` hot keys become
    literals of a filter, so no branch counts again; more are joined as a table."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    found = counts.limit(most + 1).collect()
    if not found:
        return df, None, None
    if len(found) > most:
        keys = counts.select(key)
        return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi"), counts
    is_hot = F.coalesce(F.col(key).isin([r[key] for r in found]), F.lit(False))
    return df.where(~is_hot), df.where(is_hot), df.sparkSession.createDataFrame([(r[key], r.n) for r in found], counts.schema)


def cut_series(df: DataFrame, keys: list[str], size: int, halo: int, unit: int) -> tuple[DataFrame, DataFrame]:
    """Cut the series of `keys` (rows have t and rec too) into chunks of `size` rows. Returns the rows with `chunk`
    and `kind` (CORE or HALO), where each chunk has `halo` rows of its neighbours, and the chunks (keys, chunk)."""
    units = df.withColumn("unit", F.floor(F.coalesce(F.col("t"), F.lit(-1)) / unit))
    before = Window.partitionBy(*keys).orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    counts = units.groupBy(*keys, "unit").agg(F.count("*").alias("n")).select(*keys, "unit", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, "unit").orderBy("t", "rec")
    ranked = units.withColumn("own", F.row_number().over(inside) - 1).join(counts.drop("n"), [*keys, "unit"]).withColumn("rank", F.col("offset") + F.col("own"))
    chunk, at = F.floor(F.col("rank") / size).cast("int"), F.col("rank") % size
    copies = F.array_compact(F.array(
        F.struct(chunk.alias("chunk"), F.lit(CORE).alias("kind")),
        F.when((at < halo) & (chunk > 0), F.struct((chunk - 1).alias("chunk"), F.lit(HALO).alias("kind"))),
        F.when(at >= size - halo, F.struct((chunk + 1).alias("chunk"), F.lit(HALO).alias("kind"))),
    ))
    rows = ranked.select(*df.columns, F.explode(copies).alias("c")).select(*df.columns, "c.chunk", "c.kind")
    last = counts.groupBy(*keys).agg(F.max(F.col("offset") + F.col("n")).alias("n"))
    return rows, last.select(*keys, F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).alias("chunk"))


def changes(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """True at each row that begins a (src, chunk)."""
    n = table.num_rows
    first = np.ones(n, bool)
    if n > 1:
        src, chunk = table.column("src"), table.column("chunk")
        if isinstance(src, pa.ChunkedArray):
            src, chunk = src.combine_chunks(), chunk.combine_chunks()
        first[1:] = pc.not_equal(src[1:], src[:-1]).to_numpy(zero_copy_only=False) | (np.diff(chunk.to_numpy(zero_copy_only=False)) != 0)
    return first


def whole_series(batches: Iterator[pa.RecordBatch], rows: int = 120_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of at least `rows` rows that end where a series ends, with the series' first rows marked.
    Memory is bounded by `rows` plus one chunk."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        first = changes(table)
        cut = int(np.flatnonzero(first)[-1])
        if cut == 0:
            held = table.to_batches()
            rows = max(rows, 2 * n) if n > rows else rows
            continue
        yield table.slice(0, cut), first[:cut]
        held = table.slice(cut).to_batches()
        n -= cut
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, changes(table)


def grouped_quartiles(values: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median (mean of the middle two) and the values at a quarter and three quarters of each group; NaN where a group has no value."""
    order = np.lexsort((values, group))
    v, count = values[order], np.bincount(group, minlength=groups)
    start = np.cumsum(count) - count
    median, low, high = (np.full(groups, np.nan) for _ in range(3))
    has = count > 0
    begin, n = start[has], count[has]
    median[has] = (v[begin + (n - 1) // 2] + v[begin + n // 2]) / 2
    low[has], high[has] = v[begin + n // 4], v[begin + 3 * n // 4]
    return median, low, high
