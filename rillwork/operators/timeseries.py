"""Interpolation on an integer index grid, and synchronisation of two series.

Grid and readings are laid side by side and the neighbours found with ignore-null windows. Give
`partition_by` for many series. A single long series is cut into segments of the index: the
last reading before and the first after each segment are carried in from per-segment ends, so
no task sorts the whole series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ColumnRef, col, is_numeric, name_of, names_of
from ..errors import ValidationError
from ..registry import Op, operator


@operator("interpolate")
def interpolate(index: str, step: int = 1, method: str = "LINEAR", columns: list[ColumnRef] | None = None, partition_by: list[ColumnRef] = (), keep_type: bool = False, segment: int = 100_000) -> Op:
    """Values at least(index), + step, ... up to the greatest index, per series.

    LINEAR needs numbers; NEAREST (tie: the earlier) and PREVIOUS take any type, and texts take PREVIOUS under
    LINEAR. Null readings are passed over; of several readings at one index the least value counts.
    With `keep_type` numbers are cast back to their type, else they become doubles."""
    if step < 1 or method not in ("LINEAR", "NEAREST", "PREVIOUS"):
        raise ValidationError("step must be positive and the method LINEAR, NEAREST or PREVIOUS")

    def run(df: DataFrame) -> DataFrame:
        x, by = name_of(df, index), names_of(df, partition_by)
        chosen = names_of(df, columns) if columns else [c for c in df.columns if c != x and c not in by]
        keys = [f"__k{i}" for i in range(len(by))]
        base = df.where(col(x).isNotNull()).select(*(col(b).alias(k) for b, k in zip(by, keys, strict=True)), col(x).cast("long").alias("__x"), *(F.when(col(c).isNotNull(), F.struct(col(x).cast("long").alias("x"), col(c).alias("v"))).alias(f"__v{i}") for i, c in enumerate(chosen)))
        vs = [f"__v{i}" for i in range(len(chosen))]
        base = base.groupBy(*keys, "__x").agg(*(F.min(v).alias(v) for v in vs)).withColumn("__s", F.floor(F.col("__x") / (segment * step)))
        span = base.groupBy(*keys).agg(F.min("__x").alias("__a"), F.max("__x").alias("__b")).where("__a is not null")
        # grid points are made segment by segment, so that a long series is spread before it is long
        segments = span.withColumn("__s", F.explode(F.sequence(F.floor(F.col("__a") / (segment * step)), F.floor(F.col("__b") / (segment * step)))))
        low = F.greatest(F.col("__a"), F.col("__a") + F.ceil((F.col("__s") * segment * step - F.col("__a")) / step) * step)
        high = F.least(F.col("__b"), (F.col("__s") + 1) * segment * step - 1)
        grid = segments.where(low <= high).withColumn("__x", F.explode(F.sequence(low.cast("long"), high.cast("long"), F.lit(step).cast("long")))).select(*keys, "__s", "__x", F.lit(True).alias("__g"))
        rows = base.select(*keys, "__s", "__x", *vs).join(grid, [*keys, "__s", "__x"], "full")
        ends = base.groupBy(*keys, "__s").agg(*(f(v).alias(f"{n}{v}") for v in vs for f, n in ((F.max, "l"), (F.min, "f"))))
        chain = segments.select(*keys, "__s").join(ends, [*keys, "__s"], "left")
        ordered = Window.partitionBy(*keys).orderBy("__s")
        back = ordered.rowsBetween(Window.unboundedPreceding, -1)
        ahead = Window.partitionBy(*keys).orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, -1)
        carried = chain.select(*keys, "__s", *(F.last(f"l{v}", True).over(back).alias(f"b{v}") for v in vs), *(F.last(f"f{v}", True).over(ahead).alias(f"a{v}") for v in vs))
        up = Window.partitionBy(*keys, "__s").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy(*keys, "__s").orderBy(F.desc("__x")).rowsBetween(Window.unboundedPreceding, 0)
        near = rows.select("*", *(F.last(v, True).over(up).alias(f"p{v}") for v in vs)).select("*", *(F.last(v, True).over(down).alias(f"n{v}") for v in vs)).where("__g").join(carried, [*keys, "__s"], "left")
        out = []
        for i, c in enumerate(chosen):
            prev, after = F.coalesce(f"p__v{i}", f"b__v{i}"), F.coalesce(f"n__v{i}", f"a__v{i}")
            kind, at = df.schema[c].dataType, F.col("__x")
            if method == "LINEAR" and is_numeric(df, c):
                y0, y1 = prev["v"].cast("double"), after["v"].cast("double")
                made = F.when(prev["x"] == after["x"], y0).otherwise(y0 + (at - prev["x"]) * F.try_divide(y1 - y0, (after["x"] - prev["x"]).cast("double")))
            elif method == "NEAREST":
                made = F.when(after.isNull() | (at - prev["x"] <= after["x"] - at), prev["v"]).otherwise(after["v"])
            else:
                made = prev["v"]
            out.append((made.cast(kind) if keep_type or not is_numeric(df, c) else made.cast("double")).alias(c))
        return near.select(*(F.col(k).alias(b) for b, k in zip(by, keys, strict=True)), F.col("__x").alias(x), *out)

    return run


@operator("time_synchronize")
def time_synchronize(time: str, other_time: str, step: int = 1, method: str = "LINEAR", delay: int | None = 0) -> Op:
    """Both tables on their own grids of `step` seconds, the second shifted by `delay` seconds, joined on equal times.

    delay=None shifts the second so that the reading nearest to the first table's first time falls on it.
    Times may be timestamps or integer seconds; the result has the seconds as `time`."""

    def seconds(df: DataFrame, c: str) -> DataFrame:
        kind = df.schema[c].dataType.typeName()
        value = F.unix_timestamp(col(c).cast("timestamp")) if kind.startswith("timestamp") else col(c).cast("long")
        return df.withColumn(c, value)

    def run(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = seconds(a, name_of(a, time)), seconds(b, name_of(b, other_time))
        shift = delay
        if delay is None:
            first = a.agg(F.min(col(time))).first()[0]
            gap = col(other_time) - F.lit(first)
            shift = -(b.agg(F.min_by(gap, F.struct(F.abs(gap), gap))).first()[0] or 0) if first is not None else 0
        b = b.withColumn(other_time, col(other_time) + F.lit(shift))
        left = interpolate(time, step, method)(a).withColumnRenamed(time, "time")
        right = interpolate(other_time, step, method)(b).withColumnRenamed(other_time, "time")
        right = right.withColumnsRenamed({c: f"{c}_right" for c in right.columns if c != "time" and c in left.columns})
        return left.join(right, "time")

    return run
