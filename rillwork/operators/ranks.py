"""Values at exact ranks of a whole column, without sorting it or holding it in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of one pass, and how many distinct values are brought to the driver at once.
BUCKETS, FEW = 4096, 4096


def values_at(df: DataFrame, value: Column, ranks: Callable[[int], list[int]]) -> list[float]:
    """Values at `ranks(n)` (from 0, ascending) of the n numbers of a column; [] if there are none.

    Each pass counts rows in equal buckets of the intervals that hold a wanted rank, combined on the map
    side, and goes on inside the buckets that hold it, until an interval is one value or has few rows. What
    reaches the driver is bounded by BUCKETS per rank. Nulls and NaN are passed over; infinities are values."""
    v = df.select(value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))
    head = v.agg(F.count("*").alias("n"), F.count_if(F.col("v") == float("-inf")).alias("low"), F.count(finite).alias("k"), F.min(finite).alias("lo"), F.max(finite).alias("hi")).first()
    wanted = ranks(head.n) if head.n else []
    found: dict[int, float] = {r: float("-inf") for r in wanted if r < head.low} | {r: float("inf") for r in wanted if r >= head.low + head.k}
    # interval (lo, hi, rows below it, rows in it) of each rank that is still looked for
    at = {r: (head.lo, head.hi, head.low, head.k) for r in wanted if r not in found}
    while at:
        for r, (lo, hi, _, _) in list(at.items()):
            if lo == hi:
                found[r] = lo
                del at[r]
        few = {i for i in at.values() if i[3] <= FEW}
        many = sorted(set(at.values()) - few)
        if few:
            inside = F.lit(False)
            for lo, hi, _, _ in few:
                inside = inside | F.col("v").between(lo, hi)
            counts = sorted((r.v, r.n) for r in v.where(inside).groupBy("v").agg(F.count("*").alias("n")).collect())
            for rank, (lo, hi, below, n) in list(at.items()):
                if (lo, hi, below, n) in few:
                    seen = below
                    for x, c in counts:
                        if lo <= x <= hi:
                            seen += c
                            if rank < seen:
                                found[rank] = x
                                break
                    del at[rank]
        if many:
            which, bucket = F.lit(None).cast("int"), F.lit(None).cast("int")
            for k, (lo, hi, _, _) in enumerate(many):
                here = F.col("v").between(lo, hi)
                # halves keep the width of the widest interval finite
                share = (F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2)
                which = F.when(here, k).otherwise(which)
                bucket = F.when(here, F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")).otherwise(bucket)
            rows = v.select("v", which.alias("k"), bucket.alias("b")).where("k is not null").groupBy("k", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
            for k, (lo, hi, below, n) in enumerate(many):
                mine = sorted((r.b, r.n, r.lo, r.hi) for r in rows if r.k == k)
                for rank in [r for r, i in at.items() if i == (lo, hi, below, n)]:
                    seen = below
                    for _, c, low, high in mine:
                        if rank < seen + c:
                            at[rank] = (low, high, seen, c)
                            break
                        seen += c
    return [found[r] for r in wanted]


def median_of(df: DataFrame, value: Column) -> float | None:
    """Mean of the middle two numbers; None if there are none."""
    middle = values_at(df, value, lambda n: [(n - 1) // 2, n // 2])
    return middle[0] / 2 + middle[1] / 2 if middle else None
