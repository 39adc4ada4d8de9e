"""Rolling totals over trailing periods, days without activity included.

Rows are reduced to one total per source and day first, so hot sources cost no more than
others. Each source-calendar day is then range-joined to the daily totals within its longest
trailing bound. Coarse date buckets as wide as that bound turn the range join into an
equi-join: a total is copied into the one or two buckets whose days can still see it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_totals(rows: DataFrame) -> DataFrame:
    """(src, day, value) to one row per source and day: records, readings, total, and the next day with records."""
    days = rows.where("src is not null and day is not null").groupBy("src", "day").agg(F.count("*").alias("records"), F.count("value").alias("readings"), F.sum("value").alias("total"))
    return days.withColumn("next_day", F.lead("day").over(Window.partitionBy("src").orderBy("day")))


def trailing_totals(rows: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One row per source and calendar day from its first to its last day.

    `rows` has src, day (days since 1970) and value. Columns: src, day, records (that day),
    readings_P, total_P and mean_P of each period P (P days that end with the day), last_day
    (the latest day with records within the longest period) and next_day (that day's successor).
    Defined cases: rows without source or day belong nowhere; a null value counts as a record but
    not as a reading; a period without readings has total and mean null and 0 readings."""
    longest = max(periods)
    days = daily_totals(rows)
    span = days.groupBy("src").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    calendar = span.select("src", F.explode(F.sequence("first", "last")).alias("day")).withColumn("bucket", F.floor(F.col("day") / longest))
    reach = F.array_distinct(F.array(F.floor(F.col("day") / longest), F.floor((F.col("day") + longest - 1) / longest)))
    events = days.select("src", F.col("day").alias("on"), "records", "readings", "total", "next_day", F.explode(reach).alias("bucket"))
    seen = calendar.join(events, ["src", "bucket"]).where((F.col("on") <= F.col("day")) & (F.col("on") > F.col("day") - longest))
    aggs = []
    for p in periods:
        inside = F.col("on") > F.col("day") - p
        readings, total = F.sum(F.when(inside, F.col("readings")).otherwise(0)), F.sum(F.when(inside, F.col("total")))
        aggs += [readings.alias(f"readings_{p}"), total.alias(f"total_{p}"), F.try_divide(total, readings).alias(f"mean_{p}")]
    sums = seen.groupBy("src", "day").agg(F.sum(F.when(F.col("on") == F.col("day"), F.col("records")).otherwise(0)).alias("records"), *aggs, F.max("on").alias("last_day"), F.max_by("next_day", "on").alias("next_day"))
    zero = {"records": 0} | {f"readings_{p}": 0 for p in periods}
    return calendar.select("src", "day").join(sums, ["src", "day"], "left").fillna(zero)
