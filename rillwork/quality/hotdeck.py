"""Sequential hot-deck: missing fields are filled from the nearest similar record.

Records of one detector (of one source where the detector is null) are sorted by time; a
missing field takes the nearest previous or next observed value (previous on a tie) and keeps
the donor and its distance. Fields without any donor in their group fall back to an observed
record of the same hour, marked as such.

Pure SQL windows over one shuffle. A group of more than `hot_rows` rows is cut into time
slices; what lies before and after a slice comes from per-slice first and last observed
records, so no task sorts a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import split_hot


def _observed(field: str) -> Column:
    return F.when(F.col(field).isNotNull(), F.struct(F.col("t").alias("t"), F.col("rec").alias("rec"), F.col(field).alias("v")))


def nearest_donors(rows: DataFrame, fields: tuple[str, ...], *, hot_rows: int = 200_000, slice_width: int = 1440) -> DataFrame:
    """`rows` has grp, t, rec and the fields. Returns the rows that lack a field, with prev_F and next_F structs."""
    cold, hot, _ = split_hot(rows, "grp", hot_rows)
    key, carried = ["grp"], None
    if hot is not None:
        key = ["grp", "slice"]
        hot = hot.withColumn("slice", F.floor(F.col("t") / slice_width))
        rows = cold.withColumn("slice", F.lit(0).cast("long")).unionByName(hot)
        ends = hot.groupBy(*key).agg(*(x for f in fields for x in (F.max(_observed(f)).alias(f"last_{f}"), F.min(_observed(f)).alias(f"first_{f}"))))
        back = Window.partitionBy("grp").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        ahead = Window.partitionBy("grp").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*key, *(x for f in fields for x in (F.last(f"last_{f}", True).over(back).alias(f"before_{f}"), F.last(f"first_{f}", True).over(ahead).alias(f"after_{f}"))))
    up = Window.partitionBy(*key).orderBy("t", "rec").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*key).orderBy(F.desc("t"), F.desc("rec")).rowsBetween(Window.unboundedPreceding, -1)
    wide = rows.select("*", *(F.last(_observed(f), True).over(up).alias(f"prev_{f}") for f in fields)).select("*", *(F.last(_observed(f), True).over(down).alias(f"next_{f}") for f in fields))
    wide = wide.where(" or ".join(f"{f} is null" for f in fields))
    if carried is not None:
        wide = wide.join(carried, key, "left").withColumns({f"prev_{f}": F.coalesce(f"prev_{f}", f"before_{f}") for f in fields} | {f"next_{f}": F.coalesce(f"next_{f}", f"after_{f}") for f in fields})
    return wide.select("grp", "t", "rec", *fields, *(f"prev_{f}" for f in fields), *(f"next_{f}" for f in fields))


def _per_group(rows: DataFrame, field: str) -> DataFrame | None:
    """(grp, v) if each group has one value of a field at most, else None."""
    values = rows.where(F.col("grp").isNotNull() & F.col(field).isNotNull()).groupBy("grp", field).agg(F.count("*").alias("n"))
    if values.groupBy("grp").count().where("count > 1").limit(1).count():
        return None
    return values.select(F.col("grp").alias("of"), F.col(field).cast("string").alias("constant"))


def fill_from_similar(rows: DataFrame, fields: dict[str, str], constant: tuple[str, ...] = (), **options: int) -> DataFrame:
    """One row per missing field of `rows` (grp, t in minutes, rec and typed columns).

    `fields` maps columns of `rows` to the names reported. Columns: rec_id, field_name, filled (as
    text), donor_id, distance (minutes), donor_kind ('group', 'hour' or null where nothing could be
    filled: the field then stays null). Defined cases: an unknown time counts as minute 0; a null
    group is a group of its own kind and only the hour can fill it; other columns are ignored; several donors at the same
    distance: the previous one, and of equal times the nearest record id.

    Fields named in `constant` are expected to have one value per group. If that holds for all groups
    (one aggregation tells), only whether a record has the field travels with it and the value
    is looked up per group, which is the donor's; else they are treated like the others."""
    names = tuple(fields)
    rows = rows.select("grp", F.coalesce(F.col("t"), F.lit(0)).cast("long").alias("t"), "rec", *names)
    looked_up = {f: table for f in constant if (table := _per_group(rows, f)) is not None}
    whole, rows = rows, rows.withColumns({f: F.when(F.col(f).isNotNull(), F.lit(True)) for f in looked_up})
    near = nearest_donors(rows.where("grp is not null"), names, **options)
    lost = rows.where("grp is null").where(" or ".join(f"{f} is null" for f in names))
    cases = []
    for f, name in fields.items():
        prev, after = F.col(f"prev_{f}"), F.col(f"next_{f}")
        take_next = after.isNotNull() & (prev.isNull() | (after["t"] - F.col("t") < F.col("t") - prev["t"]))
        donor = F.when(take_next, after).otherwise(prev)
        cases.append(F.when(F.col(f).isNull(), F.struct(F.lit(name).alias("field_name"), donor["v"].cast("string").alias("filled"), donor["rec"].alias("donor_id"), F.abs(donor["t"] - F.col("t")).alias("distance"))))
    nothing = [F.when(F.col(f).isNull(), F.struct(F.lit(name).alias("field_name"), F.lit(None).cast("string").alias("filled"), F.lit(None).cast("long").alias("donor_id"), F.lit(None).cast("long").alias("distance"))) for f, name in fields.items()]
    one = near.select("grp", F.col("rec").alias("rec_id"), "t", F.explode(F.array_compact(F.array(*cases))).alias("c")).unionByName(lost.select("grp", F.col("rec").alias("rec_id"), "t", F.explode(F.array_compact(F.array(*nothing))).alias("c")))
    one = one.select("grp", "rec_id", "t", "c.*")
    for f, table in looked_up.items():
        mine = F.col("field_name") == fields[f]
        # rows of other fields match nothing, and spread by their id
        joined = one.join(table, (F.when(mine, F.col("grp")).otherwise(F.col("rec_id").cast("string")) == F.col("of")) & mine, "left")
        one = joined.withColumn("filled", F.when(mine, F.when(F.col("donor_id").isNotNull(), F.col("constant"))).otherwise(F.col("filled"))).select(*one.columns)
    # records of the same hour, one donor a field: what is left without a donor in its group
    hours = whole.groupBy(F.floor(F.col("t") / 60).alias("hour")).agg(*(F.min(_observed(f)).alias(f"any_{f}") for f in names))
    donors = hours.select("hour", F.explode(F.array(*(F.struct(F.lit(name).alias("field_name"), F.col(f"any_{f}")["v"].cast("string").alias("h_filled"), F.col(f"any_{f}")["rec"].alias("h_donor"), F.col(f"any_{f}")["t"].alias("h_t")) for f, name in fields.items()))).alias("h")).select("hour", "h.*")
    full = one.withColumn("hour", F.floor(F.col("t") / 60)).join(donors, ["hour", "field_name"], "left")
    alone = F.col("filled").isNull()
    return full.select(
        "rec_id", "field_name", F.coalesce("filled", "h_filled").alias("filled"), F.when(alone, F.col("h_donor")).otherwise(F.col("donor_id")).alias("donor_id"),
        F.when(alone, F.abs(F.col("h_t") - F.col("t"))).otherwise(F.col("distance")).alias("distance"),
        F.when(~alone, "group").when(F.col("h_filled").isNotNull(), "hour").alias("donor_kind"),
    )
