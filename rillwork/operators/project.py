"""Projection, renaming, casts and derived columns. Plain expressions, so nothing shuffles
(but `add_zone_id` in incremental mode, which needs a total order)."""

from __future__ import annotations

import operator as ops
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ColumnRef, col, is_text, name_of, names_of, spark_type
from ..errors import ValidationError
from ..registry import Op, operator
from ..session import use_checkpoints

_ARITHMETIC = {"SUM": ops.add, "MINUS": ops.sub, "MULTIPLY": ops.mul, "DIVIDE": F.try_divide}


@operator("select_columns")
def select_columns(columns: list[ColumnRef] = (), names: list[str] = (), order: str | None = None, new_names: list[str] | None = None) -> Op:
    """Positions, then names; `order`, a comma list of names, replaces both."""

    def run(df: DataFrame) -> DataFrame:
        chosen = names_of(df, order.split(",")) if order else names_of(df, [*columns, *names])
        out = df.select(*map(col, chosen))
        return out.toDF(*new_names) if new_names else out

    return run


def _names_in(df: DataFrame, path: str, most: int = 100_000) -> list[str]:
    """Comma-separated names of a text file; one of more than `most` lines is no list of columns and refused."""
    lines = [r.value for r in df.sparkSession.read.text(path).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValidationError(f"{path} has more than {most} lines")
    return [n for line in lines for n in line.split(",") if n.strip()]


@operator("select_columns_from_file")
def select_columns_from_file(path: str) -> Op:
    """Names from a text file of comma-separated names (any path that Spark can read)."""

    def run(df: DataFrame) -> DataFrame:
        return select_columns(names=_names_in(df, path))(df)

    return run


@operator("drop_columns")
def drop_columns(columns: list[ColumnRef]) -> Op:
    return lambda df: df.drop(*names_of(df, columns))


@operator("rename_columns")
def rename_columns(pairs: list[tuple[str, str]]) -> Op:
    """(existing, new) pairs, one after another: a later pair sees the names made by earlier ones."""

    def run(df: DataFrame) -> DataFrame:
        now = list(df.columns)
        for old, new in pairs:
            if old not in now:
                raise ValidationError(f"no column {old!r}")
            now = [new if c == old else c for c in now]
        return df.toDF(*now)

    return run


@operator("rename_by_position")
def rename_by_position(renames: list[dict], first: int = 0) -> Op:
    """[{index, name, type?}], counted from `first` (0, or 1 for one-based lists); other columns stay in place."""

    def run(df: DataFrame) -> DataFrame:
        by = {r["index"] - first: r for r in renames}
        for i in by:
            name_of(df, i)
        out = []
        for i, c in enumerate(df.columns):
            r = by.get(i)
            e = col(c) if r is None or not r.get("type") else col(c).try_cast(spark_type(r["type"]))
            out.append(e.alias(r["name"] if r else c))
        return df.select(*out)

    return run


@operator("rename_all_from_file")
def rename_all_from_file(path: str) -> Op:
    """All names from a text file, comma-separated, in column order."""

    def run(df: DataFrame) -> DataFrame:
        return df.toDF(*[n.strip() for n in _names_in(df, path)])

    return run


@operator("cast_columns")
def cast_columns(types: list[tuple[ColumnRef, str]]) -> Op:
    """Casts to the declarable types; what can't be cast is null."""
    return lambda df: df.withColumns({name_of(df, c): col(name_of(df, c)).try_cast(spark_type(t)) for c, t in types})


@operator("add_conditional")
def add_conditional(name: str, rules: list[tuple[str, str]]) -> Op:
    """A column of the first value whose SQL condition holds, null where none does."""

    def run(df: DataFrame) -> DataFrame:
        if not rules:
            raise ValidationError("no rules")
        return df.withColumn(name, reduce(lambda c, r: c.when(F.expr(r[0]), F.lit(r[1])), rules, F))

    return run


@operator("column_arithmetic")
def column_arithmetic(columns: list[ColumnRef], op: str, new_name: str | None = None, constant: float | None = None) -> Op:
    """Combine columns row by row into `new_name`, or each column with a constant in place. Division by zero is null."""
    f = _ARITHMETIC[op.upper()]

    def run(df: DataFrame) -> DataFrame:
        chosen = names_of(df, columns)
        if constant is not None:
            return df.withColumns({c: f(col(c).cast("double"), F.lit(float(constant))) for c in chosen})
        if not new_name:
            raise ValidationError("a new name or a constant is needed")
        return df.withColumn(new_name, reduce(f, map(col, chosen)))

    return run


@operator("add_zone_id")
def add_zone_id(name: str = "zoneId", mode: str = "INCREMENTAL", order_by: list[ColumnRef] = (), value: int = 0, low: int = 0, high: int = 0, seed: int = 7) -> Op:
    """An int column: a fixed value, uniform in [low, high], or 0, 1, 2, ... by `order_by`.

    Numbering is exact without a single-task sort: rows are range-partitioned by the order, numbered
    inside their partition and shifted by the partitions' counts."""

    def run(df: DataFrame) -> DataFrame:
        if mode == "FIXED":
            return df.withColumn(name, F.lit(value).cast("int"))
        if mode == "RANDOM":
            return df.withColumn(name, (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("int"))
        return numbered(df, names_of(df, order_by), name).withColumn(name, (col(name) - 1).cast("int"))

    return run


def numbered(df: DataFrame, order: list[str], name: str, descending: bool = False, hot_rows: int = 1_000_000) -> DataFrame:
    """Consecutive row numbers from 1 by the columns `order` (which must make a total order) without
    one task for all rows.

    A histogram of the leading column gives each of its values a first number; rows are then numbered
    within their value. If a value has more than `hot_rows` rows, rows are range-partitioned by all
    of `order` instead, written down, and numbered within their range."""
    if not order:
        raise ValidationError("an order is needed")
    use_checkpoints(df.sparkSession)
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    keys = [col(c).desc() if descending else col(c).asc() for c in order]
    lead = f"{name}__lead"
    # written down, as the uses below must see the same range partitions
    buckets = df.groupBy(col(order[0]).alias(lead)).count().repartitionByRange(turn(lead)).withColumn("__part", F.spark_partition_id()).checkpoint()
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over partitions, not rows
    if (buckets.agg(F.max("count")).first()[0] or 0) > hot_rows:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()).checkpoint()
        shift = placed.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__shift"))
        inside = placed.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)))
        return inside.join(shift, "__part").withColumn(name, F.col("__shift") + F.col("__in")).drop("__part", "__in", "__shift")
    sums = buckets.groupBy("__part").agg(F.sum("count").alias("__n"))
    shift = sums.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("__part").orderBy(turn(lead)).rowsBetween(Window.unboundedPreceding, -1)
    first = buckets.withColumn("__own", F.coalesce(F.sum("count").over(inside), F.lit(0))).join(shift, "__part").select(F.col(lead).alias("__lead"), (F.col("__own") + F.col("__shift")).alias("__first"))
    ranked = df.withColumn("__in", F.row_number().over(Window.partitionBy(col(order[0])).orderBy(*keys)))
    return ranked.join(first, col(order[0]).eqNullSafe(F.col("__lead"))).withColumn(name, F.col("__first") + F.col("__in")).drop("__lead", "__in", "__first")


@operator("add_time_index")
def add_time_index(column: ColumnRef, pattern: str, name: str = "timestamp") -> Op:
    """Parse a column into a timestamp; null where it doesn't fit the pattern."""
    return lambda df: df.withColumn(name, F.try_to_timestamp(col(name_of(df, column)).cast("string"), F.lit(pattern)))


@operator("concat_columns")
def concat_columns(columns: list[ColumnRef], delimiter: str, name: str, keep: str = "KEEP_ORIGINAL_AND_RESULT") -> Op:
    """Join columns' texts; null if any is null. The result stays beside all columns, replaces the sources, or stands alone."""

    def run(df: DataFrame) -> DataFrame:
        chosen = names_of(df, columns)
        parts = [x for c in chosen for x in (F.lit(delimiter), col(c).cast("string"))][1:]
        out = df.withColumn(name, F.concat(*parts))
        if keep == "REPLACE_SELECTED_WITH_RESULT":
            return out.drop(*(c for c in chosen if c != name))
        return out.select(col(name)) if keep == "REFINEMENT_RESULT_ONLY" else out

    return run


@operator("null_replace")
def null_replace(empty_as_null: bool = True, zero_as_null: bool = False) -> Op:
    """Empty texts and, if asked, zeros become null; types stay."""

    def run(df: DataFrame) -> DataFrame:
        change = {}
        for f in df.schema.fields:
            if empty_as_null and is_text(df, f.name):
                change[f.name] = F.when(F.length(col(f.name)) > 0, col(f.name))
            elif zero_as_null and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal"):
                change[f.name] = F.when(col(f.name) != 0, col(f.name))
        return df.withColumns(change) if change else df

    return run


@operator("explode_column")
def explode_column(column: str, name: str | None = None) -> Op:
    """One row per array element, in place or as `name`; other types stay as they are. Null and empty arrays give no row."""

    def run(df: DataFrame) -> DataFrame:
        c = name_of(df, column)
        if df.schema[c].dataType.typeName() != "array":
            return df
        return df.withColumn(name or c, F.explode(col(c)))

    return run


@operator("split_column")
def split_column(column: str, keep: bool = False, width: int | None = None) -> Op:
    """A struct to its fields, an array to `<name>0`, `<name>1`, ... as wide as the longest (one aggregate) or `width`."""

    def run(df: DataFrame) -> DataFrame:
        c = name_of(df, column)
        kind = df.schema[c].dataType
        if kind.typeName() == "struct":
            added = [F.col(f"`{c}`.`{f}`").alias(f) for f in kind.names]
        elif kind.typeName() == "array":
            n = width if width is not None else df.agg(F.max(F.size(col(c)))).first()[0] or 0
            added = [F.get(col(c), F.lit(i)).alias(f"{c}{i}") for i in range(max(n, 0))]
        else:
            raise ValidationError(f"{c} is neither a struct nor an array")
        return df.select(*(col(x) for x in df.columns if keep or x != c), *added)

    return run


@operator("extract_onem2m")
def extract_onem2m(column: str, name: str = "content") -> Op:
    """The content of a oneM2M notification: plain, or base64 text (encoding 1); null for other encodings or shapes."""

    def run(df: DataFrame) -> DataFrame:
        cin = "$['m2m:sgn'].nev.rep['m2m:cin']"
        con, cnf = (F.get_json_object(col(name_of(df, column)), f"{cin}.{k}") for k in ("con", "cnf"))
        coding = F.element_at(F.split(F.coalesce(cnf, F.lit("")), ":"), -1)
        return df.withColumn(name, F.when(coding == "1", F.try_to_binary(con, F.lit("base64")).cast("string")).when(coding == "2", F.lit(None)).otherwise(con))

    return run
