"""What counts as "no value" in sensor tables, learned from the table itself.

A field is missing if it is null, not a number or blank, or if it holds a stand-in.
Stand-ins are found by how they recur, not by a list of numbers:

* a source id is a stand-in if the detectors that sent it mostly belong to other sources
  (`min_foreign` different ones at least, and more than it has detectors of its own);
* a measurement is a stand-in if one fixed value, negative or far above all common values,
  makes up `min_share` of the readings and recurs on `min_sources` of all sources. Zero never is.

`fit` runs three aggregations, pre-aggregated on the map side. What it brings to the
driver is bounded by the thresholds (at most 1 / min_share values a field), not by the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError

#: Buckets of a factor e in which quartiles are looked for.
BUCKETS = 16
#: Spellings that say "no value" in an id.
NULL_WORDS = ("null", "none", "nan", "na", "n/a", "nil", "unknown", "undefined", "missing")


@dataclass(frozen=True)
class MissingRules:
    sources: tuple[str, ...] = ()
    values: tuple[tuple[str, tuple[float, ...]], ...] = ()

    def source(self, col: str) -> Column:
        """The source id, null where it is missing."""
        c = F.col(col)
        word = F.lower(F.trim(c))
        bare = ~c.rlike("[\\p{L}\\p{N}]") | word.isin(*NULL_WORDS)
        if self.sources:
            bare = bare | c.isin(*self.sources)
        return F.when(~bare, c)

    def value(self, col: str) -> Column:
        """The measurement as a double, null where it is missing."""
        c = F.col(col).cast("double")
        ok = ~F.isnan(c)
        if stand_ins := dict(self.values).get(col):
            ok = ok & ~c.isin(*stand_ins)
        return F.when(c.isNotNull() & ok, c)


def fit(df: DataFrame, source: str, detector: str | None, fields: tuple[str, ...], *, min_foreign: int = 2, min_share: float = 2e-4, min_rows: int = 5, min_sources: float = 0.05, far: float = 6.0, most: int = 10_000) -> MissingRules:
    """Learn the stand-ins of `source` and of the numeric `fields`; see the module's text.
    An empty table gives rules without stand-ins; more than `most` ids that look like stand-ins are an error."""
    plain = MissingRules()
    found: tuple[str, ...] = ()
    src, sources = plain.source(source), 0
    if detector:
        pairs = df.select(F.col(detector).alias("d"), src.alias("s")).where("d is not null and s is not null").groupBy("d", "s").agg(F.count("*").alias("n"))
        homes = pairs.withColumn("home", F.max(F.struct("n", "s")).over(Window.partitionBy("d"))["s"])
        spread = homes.groupBy("s").agg(F.count_distinct(F.when(F.col("s") != F.col("home"), F.col("home"))).alias("foreign"), F.count_if(F.col("s") == F.col("home")).alias("own"))
        odd = (F.col("foreign") >= min_foreign) & (F.col("foreign") > F.col("own"))
        spread = spread.select("s", odd.alias("odd")).persist()  # one row per source, asked twice
        try:
            seen = spread.agg(F.count_if("odd").alias("odd"), F.count_if(~F.col("odd")).alias("k")).first()
            if seen.odd > most:
                raise ValidationError(f"{seen.odd} source ids look like stand-ins, more than {most}")
            found, sources = tuple(sorted(r.s for r in spread.where("odd").select("s").collect())) if seen.odd else (), seen.k
        finally:
            spread.unpersist()
    rules = MissingRules(found)
    if not fields:
        return rules
    known = rules.source(source)
    if not detector:
        sources = df.agg(F.approx_count_distinct(known)).first()[0]
    cells = F.stack(F.lit(len(fields)), *(x for i, f in enumerate(fields) for x in (F.lit(i), plain.value(f)))).alias("f", "v")
    # quartiles by logarithmic buckets: at most one row per field and bucket, whatever the table's size
    shape = df.select(cells).groupBy("f", F.when(F.col("v") > 0, F.floor(F.ln("v") * BUCKETS)).alias("b")).agg(F.count("*").alias("n")).collect()
    rows = sum(r.n for r in shape if r.f == 0)
    limit = F.lit(None).cast("double")
    for i in range(len(fields)):
        hist = sorted((r.b, r.n) for r in shape if r.f == i and r.b is not None)
        if hist:
            ends = np.cumsum([n for _, n in hist])
            low, high = (math.exp((hist[int(np.searchsorted(ends, ends[-1] * share, "right"))][0] + 0.5) / BUCKETS) for share in (0.25, 0.75))
            limit = F.when(F.col("f") == i, high + far * max(high - low, high / BUCKETS)).otherwise(limit)
    odd = df.select(known.alias("s"), cells).where(F.col("v").isNotNull() & ((F.col("v") < 0) | (F.col("v") > limit)))
    often = odd.groupBy("f", "v", "s").agg(F.count("*").alias("n")).groupBy("f", "v").agg(F.sum("n").alias("n"), F.count("s").alias("sources"))
    rows = often.where((F.col("n") >= max(min_rows, min_share * rows)) & (F.col("sources") >= max(2, min_sources * sources))).collect()
    return MissingRules(found, tuple((f, tuple(sorted(r.v for r in rows if r.f == i))) for i, f in enumerate(fields)))


#: Days of the months.
_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def day_number(year: str = "prcs_year", month: str = "prcs_mon", day: str = "prcs_day") -> Column:
    """Days since 1970 from textual date parts, with or without leading zero; null if there is no such date."""
    y, m, d = (F.col(c).try_cast("int") for c in (year, month, day))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.get(F.array(*map(F.lit, _DAYS)), m - 1) + F.when((m == 2) & leap, 1).otherwise(0)
    return F.when(y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= last), F.unix_date(F.make_date(y, m, d)))


def minute_number(hour: str = "prcs_hh", minute: str = "prcs_min", **parts: str) -> Column:
    """Minutes since 1970 from textual date and time parts; null if a part is no valid number."""
    h, m = F.col(hour).try_cast("int"), F.col(minute).try_cast("int")
    return F.when(h.between(0, 23) & m.between(0, 59), day_number(**parts) * 1440 + h * 60 + m)
