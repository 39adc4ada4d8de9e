"""Irregular readings onto a regular grid.

Per source, grid and readings are sorted and merged as-of: every cell of the grid looks back to the
last and ahead to the next reading. Steps without a record are marked, and filled from the
neighbours (linear by time, nearest, or previous) unless these are further apart than the gap
limit; longer gaps get no steps at all, as the source is off.

Scale: records become one cell per source and step first, combined on the map side, so a hot source
weighs no more than its steps. A source's steps are cut into chunks of `chunk_steps` whole steps,
whatever its size; each chunk is told the last cell and reading before it and the next ones after
it, which come from one row per chunk. So no step is ever cut, and no distance to a neighbour is too far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import whole_series
from ..session import is_small, wall_micros
from .lateness import reading_sql

SCHEMA = "sensor_id string, slot_epoch long, value double, n_records long, status string, method string"
STATUS = ("observed", "filled", "marked")
METHODS = ("LINEAR", "NEAREST", "PREVIOUS")
MICROS = 1_000_000
_CELL = ("n", "k", "total", "t0", "t1", "r0", "v0", "r1", "v1")


def _whole(table: pa.Table, column: str) -> np.ndarray:
    return table[column].to_numpy()


def _real(table: pa.Table, column: str) -> np.ndarray:
    return table[column].to_numpy().astype(float)


def _latest(has: np.ndarray) -> np.ndarray:
    """Index of the last true element before each one, -1 where there is none."""
    seen = np.maximum.accumulate(np.where(has, np.arange(len(has)), -1))
    return np.concatenate([[-1], seen[:-1]])


def _grid(gap_s: int):
    gap = gap_s * MICROS
    out = pa.schema([("sensor_id", pa.string()), ("slot_epoch", pa.int64()), ("value", pa.float64()), ("n_records", pa.int64()), ("status", pa.string()), ("method", pa.string())])
    method_names = pa.array(["", *METHODS])

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_series(batches):
            # each series is a header, which tells what lies around the chunk, and the chunk's cells.
            # The header stands for the cell before; a copy of it at the end stands for the cell after.
            n = table.num_rows
            begin = np.flatnonzero(first)
            size = np.diff(np.append(begin, n))
            at = np.insert(np.arange(n), np.append(begin[1:], n), begin)
            series = np.repeat(np.arange(len(begin)), size + 1)
            tail = np.cumsum(size + 1) - 1
            head = tail - size
            body = np.ones(len(at), bool)
            body[head] = body[tail] = False
            cols = {c: _real(table, c)[at] if c in ("total", "v0", "v1") else _whole(table, c)[at] for c in ("slot", "step", "method", *_CELL)}
            # a header's t0, r0 and v0 belong to the cell after, its t1, r1 and v1 to the cell before
            n_rec, k, slot, step = cols["n"], cols["k"], cols["slot"], cols["step"]
            t0, t1, r0, r1, v0, v1 = (cols[c] for c in ("t0", "t1", "r0", "r1", "v0", "v1"))
            joined = np.zeros(len(at), bool)  # to the cell that follows
            joined[:-1] = (series[1:] == series[:-1]) & (t0[1:] - t1[:-1] <= gap)
            cells = np.flatnonzero(body)
            after = cells + 1
            slot[tail] = n_rec[tail]  # where the next chunk begins
            counts = np.where(joined[cells], (slot[after] - slot[cells]) // step[cells], 1)
            own = np.repeat(cells, counts)
            j = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            grid_t = slot[own] + j * step[own]
            width = step[own]
            # as-of merge in both directions: the readings' cells before and after
            readable = (k > 0) & body
            readable[head], readable[tail] = ~np.isnan(v1[head]), ~np.isnan(v0[tail])
            back = _latest(readable)
            ahead = len(at) - 1 - _latest(readable[::-1])[::-1]
            p = np.where((j > 0) & readable[own], own, back[own])
            q = ahead[own]
            p_ok = (p >= 0) & ((j > 0) | joined[own - 1])
            q_ok = (q < len(at)) & joined[own]
            p, q = np.where(p_ok, p, 0), np.where(q_ok, q, 0)
            p_ok &= series[p] == series[own]
            q_ok &= series[q] == series[own]
            since, until = grid_t - r1[p], r0[q] - grid_t
            before, later = p_ok & (since <= gap), q_ok & (until <= gap + width)
            linked = before & later & (since + until <= gap)
            share = np.where(linked, since / np.maximum(since + until, 1), 0)
            near = np.where(before & (~later | (since <= until)), v1[p], v0[q])
            code = cols["method"][own]
            fill = np.select([code == 1, code == 2, code == 3], [np.where(linked, v1[p] + (v0[q] - v1[p]) * share, np.nan), np.where(before | later, near, np.nan), np.where(before, v1[p], np.nan)], np.nan)
            mine = j == 0
            observed = mine & (k[own] > 0)
            mean = np.where(k[own] == 1, v0[own], cols["total"][own] / np.maximum(k[own], 1))
            value = np.where(observed, mean, fill)
            status = np.where(observed, 0, np.where(np.isnan(fill), 2, 1))
            src = table["src"].combine_chunks() if isinstance(table["src"], pa.ChunkedArray) else table["src"]
            yield from pa.Table.from_arrays([
                src.take(pa.array(at[own])), pa.array(grid_t // MICROS), pa.array(value, mask=np.isnan(value)), pa.array(np.where(mine, n_rec[own], 0)),
                pa.array(STATUS).take(pa.array(status)), method_names.take(pa.array(code)),
            ], schema=out).to_batches()

    return grid


def _kinds(base: DataFrame, conf: DataFrame, small: int) -> DataFrame:
    """(src, step in microseconds, method) of each source whose type has a step."""
    code = F.coalesce(F.array_position(F.array(*map(F.lit, METHODS)), F.upper("method_option")), F.lit(0)).cast("int")
    rules = conf.where("sensor_type is not null and step_size > 0").groupBy(F.col("sensor_type").cast("int").alias("type")).agg((F.max("step_size").cast("long") * MICROS).alias("step"), F.max_by(code, "step_size").alias("method"))
    kinds = base.groupBy("src").agg(F.max("type").alias("type")).join(rules, "type").select("src", "step", "method")
    if not is_small(kinds, small):
        return kinds
    return F.broadcast(base.sparkSession.createDataFrame(kinds.collect(), kinds.schema))


def regular_grid(records: DataFrame, conf: DataFrame, *, gap_seconds: int = 86_400, chunk_steps: int = 4096, small: int = 100_000) -> DataFrame:
    """One row per sensor and step between its records that are at most `gap_seconds` apart.

    `status`: 'observed' (a reading falls into the step; several are averaged), 'filled' or 'marked'
    (nothing to fill it from). `n_records` counts the step's records, readable or not: 0 is a missing
    step. `conf` has one row per sensor type with step_size and method_option. The sensors' types
    are broadcast where there are at most `small` sensors, else joined. Defined
    cases: records without sensor or time, or later than their arrival, are left out; sensors whose
    type is unknown or has no step get no grid; of several types the greatest counts; repeated records count for one step as before;
    of readings at one instant the one with the greater msg_id is the nearer to what follows, the
    one with the smaller to what comes before; a gap of exactly the limit is still filled."""
    base = records.where("sensor_id is not null and ts is not null and ts <= arrived_at").select(F.col("sensor_id").alias("src"), wall_micros("ts").alias("t"), F.coalesce(F.col("msg_id").cast("long"), F.lit(0)).alias("rec"), F.expr(reading_sql("event_body")).alias("v"), F.col("sensor_type").cast("int").alias("type"))
    base = base.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    stepped = base.join(_kinds(base, conf, small), "src")
    slot = F.expr("t - pmod(t, step)")
    # one number that orders readings by time, then by id: decimals are combined without sorting
    order = F.when(F.col("v").isNotNull(), F.col("t").cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col("rec"))
    read_at = F.when(F.col("v").isNotNull(), F.col("t"))
    cells = stepped.withColumns({"slot": slot, "at": order, "rt": read_at}).groupBy("src", "slot", "step", "method").agg(
        F.count("*").alias("n"), F.count("v").alias("k"), F.sum("v").alias("total"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("rt").alias("r0"), F.min_by("v", "at").alias("v0"), F.max("rt").alias("r1"), F.max_by("v", "at").alias("v1"))
    cells = cells.withColumn("chunk", F.expr(f"(slot - pmod(slot, step * {chunk_steps})) div (step * {chunk_steps})"))
    return _merged(cells).mapInArrow(_grid(gap_seconds), SCHEMA)


def _merged(cells: DataFrame) -> DataFrame:
    """Cells under a header per chunk, whose fields are named as in a cell: t1, r1 and v1 of what lies
    before the chunk; t0, r0 and v0 of what lies after it, and as `n` the slot of the next cell."""
    has = F.col("k") > 0
    ends = cells.groupBy("src", "chunk", "step", "method").agg(
        # whole cells, so that the plan is the cells' own and their exchange is used twice
        F.min(F.struct("slot", "t0", "n", "k", "total", "t1")).alias("first"), F.max(F.struct("slot", "t1")).alias("last"),
        F.min(F.when(has, F.struct("r0", "v0"))).alias("first_read"), F.max(F.when(has, F.struct("r1", "v1"))).alias("last_read"))
    up, down = Window.partitionBy("src").orderBy("chunk"), Window.partitionBy("src").orderBy(F.desc("chunk"))
    carried = lambda c, w: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(c)
    around = ends.select("src", "chunk", "step", "method", carried("first", down), carried("last", up), carried("first_read", down), carried("last_read", up))
    far = F.lit(2**61)
    heads = around.select(
        "src", "chunk", F.lit(-(2**62)).alias("slot"), "step", "method", F.coalesce("first.slot", far).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("total"),
        F.coalesce("first.t0", far).alias("t0"), F.coalesce("last.t1", -far).alias("t1"), F.coalesce("first_read.r0", far).alias("r0"), F.col("first_read.v0").alias("v0"), F.coalesce("last_read.r1", -far).alias("r1"), F.col("last_read.v1").alias("v1"))
    filled: dict[str, Column] = {"total": F.coalesce("total", F.lit(0.0)), "r0": F.coalesce("r0", far), "r1": F.coalesce("r1", -far)}
    rows = cells.withColumns(filled).select(*heads.columns).unionByName(heads)
    return rows.repartition("src", "chunk").sortWithinPartitions("src", "chunk", "slot")
