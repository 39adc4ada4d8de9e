"""How private and how useful an anonymised table is. Each measure is a one-row table.

Classes are counted with map-side combine; everything else works on the class table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import ColumnRef, col, names_of
from ..errors import ValidationError
from ..registry import Op


def _sizes(df: DataFrame, quasi: list[ColumnRef]) -> DataFrame:
    return df.groupBy(*map(col, names_of(df, quasi))).agg(F.count("*").alias("n"))


def _value_counts(df: DataFrame, quasi: list[ColumnRef], sensitive: ColumnRef) -> DataFrame:
    q, (s,) = names_of(df, quasi), names_of(df, [sensitive])
    return df.groupBy(*(col(c).alias(f"q{i}") for i, c in enumerate(q)), col(s).alias("s")).agg(F.count("*").alias("c"))


def _keys(quasi: list) -> list[str]:
    return [f"q{i}" for i in range(len(quasi))]


def k_anonymity(df: DataFrame, quasi: list[ColumnRef], k: int | None = None) -> DataFrame:
    """k: the size of the smallest class; with `k`, whether it is at least that."""
    out = _sizes(df, quasi).agg(F.min("n").alias("k"))
    return out.withColumn("satisfied", F.col("k") >= k) if k is not None else out


def l_diversity(df: DataFrame, quasi: list[ColumnRef], sensitive: ColumnRef, method: str = "DISTINCT") -> DataFrame:
    """The worst class by distinct values (least), greatest share of one value (most; `least` is given too) or entropy (least)."""
    per = _value_counts(df, quasi, sensitive)
    total = per.groupBy(*_keys(quasi)).agg(F.sum("c").alias("n"), F.max("c").alias("m"), F.count("s").alias("d"), (F.sum(F.col("c") * F.ln("c"))).alias("e"))
    if method == "DISTINCT":
        return total.agg(F.min("d").alias("l"))
    if method == "PROBABILISTIC":
        return total.agg(F.max(F.col("m") / F.col("n")).alias("l"), F.min(F.col("m") / F.col("n")).alias("least"))
    # -sum p ln p = ln n - sum c ln c / n
    return total.agg(F.min(F.ln("n") - F.col("e") / F.col("n")).alias("l"))


def recursive_l_diversity(df: DataFrame, quasi: list[ColumnRef], sensitive: ColumnRef, c: float, l: int) -> DataFrame:  # noqa: E741
    """Whether each class has at least l values, the most frequent of which is rarer than c times all others together."""
    per = _value_counts(df, quasi, sensitive).groupBy(*_keys(quasi)).agg(F.sum("c").alias("n"), F.max("c").alias("m"), F.count("*").alias("d"))
    return per.agg(F.bool_and((F.col("d") >= l) & (F.col("m") < c * (F.col("n") - F.col("m")))).alias("satisfied"))


def t_closeness(df: DataFrame, quasi: list[ColumnRef], sensitive: ColumnRef) -> DataFrame:
    """Half the summed difference between a class's and the table's shares of each value: `t` of the worst class and `t_sum` of all.

    Values that a class lacks add their whole share, which is 1 minus the share of those it has; so no grid is made."""
    per = _value_counts(df, quasi, sensitive)
    overall = per.groupBy("s").agg(F.sum("c").alias("a")).withColumnRenamed("s", "_s")
    total = df.agg(F.count("*")).scalar()
    keys = _keys(quasi)
    sizes = per.groupBy(*keys).agg(F.sum("c").alias("n")).withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    share = per.join(sizes, on).join(overall, F.col("s").eqNullSafe(F.col("_s"))).select(*keys, (F.col("c") / F.col("n")).alias("p"), (F.col("a") / total).alias("q"))
    t = share.groupBy(*keys).agg(((F.sum(F.abs(F.col("p") - F.col("q"))) + 1 - F.sum("q")) / 2).alias("t"))
    return t.agg(F.max("t").alias("t"), F.sum("t").alias("t_sum"))


def aecs_loss(df: DataFrame, quasi: list[ColumnRef]) -> DataFrame:
    """Average class size: rows / classes."""
    return _sizes(df, quasi).agg((F.sum("n") / F.count("*")).alias("aecs"))


def discernibility(df: DataFrame, quasi: list[ColumnRef], fill: str = "*") -> DataFrame:
    """Sum of squared class sizes; classes that are wholly suppressed cost the table's size for each of their rows."""
    q = names_of(df, quasi)
    gone = F.lit(True)
    for c in q:
        gone = gone & F.coalesce(col(c).cast("string") == fill, F.lit(False))
    per = _sizes(df, quasi).select("n", gone.alias("gone"))
    parts = per.agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("gone"), F.col("n"))), F.lit(0)).alias("lost"), F.coalesce(F.sum(F.when(~F.col("gone"), F.col("n") * F.col("n"))), F.lit(0)).alias("kept"))
    return parts.select((F.col("kept") + F.col("lost") * F.col("all")).alias("dm"))


def cardinality_loss(original: DataFrame, anonymous: DataFrame, columns: list[ColumnRef]) -> DataFrame:
    """Mean over columns of 1 - distinct values after / before, not below 0."""
    names = names_of(original, columns)
    after = anonymous.agg(F.array(*(F.count_distinct(col(c)) for c in names))).scalar()
    before = original.agg(*(F.count_distinct(col(c)).alias(f"o{i}") for i, c in enumerate(names)))
    loss = [F.greatest(F.lit(0.0), 1 - F.get(after, F.lit(i)) / F.col(f"o{i}")) for i in range(len(names))]
    return before.select((sum(loss[1:], loss[0]) / len(loss)).alias("cardinality_loss"))


def equivalence_loss(original: DataFrame, anonymous: DataFrame, quasi: list[ColumnRef]) -> DataFrame:
    """1 - classes after / before."""
    after = _sizes(anonymous, quasi).agg(F.count("*")).scalar()
    return _sizes(original, quasi).agg(F.count("*").alias("o")).select((1 - after / F.col("o")).alias("equivalence_loss"))


def hierarchical_loss(anonymous: DataFrame, hierarchies: dict[str, DataFrame]) -> DataFrame:
    """Sum over cells of level / greatest level, a cell's level being the lowest of its column's hierarchy that has its value."""
    total = None
    for c, table in hierarchies.items():
        top = len(table.columns) - 1
        levels = table.select(F.explode(F.array(*(F.struct(col(n).cast("string").alias("v"), F.lit(i).alias("d")) for i, n in enumerate(table.columns)))).alias("x")).groupBy("x.v").agg(F.min("x.d").alias("d"))
        values = anonymous.groupBy(col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
        part = values.join(levels, "v", "left").agg(F.coalesce(F.sum(F.col("n") * F.coalesce("d", F.lit(top)) / top), F.lit(0.0)).alias("x"))
        total = part if total is None else total.unionByName(part)
    return total.agg(F.sum("x").alias("hierarchical_loss"))


def reidentification_risk(df: DataFrame, quasi: list[ColumnRef]) -> DataFrame:
    """Of the worst row: 1 / size of the smallest class."""
    return _sizes(df, quasi).agg((F.lit(1.0) / F.min("n")).alias("risk"))


def global_risk(df: DataFrame, quasi: list[ColumnRef]) -> DataFrame:
    """Mean of 1 / size over classes."""
    return _sizes(df, quasi).agg(F.avg(F.lit(1.0) / F.col("n")).alias("global_risk"))


#: What `check` can be asked for; each makes a one-row table of original, anonymous, quasi-identifiers and sensitive column.
LOSSES = {
    "AECS": lambda o, a, q, s: aecs_loss(a, q),
    "DISCERNIBILITY": lambda o, a, q, s: discernibility(a, q),
    "CARDINALITY": lambda o, a, q, s: cardinality_loss(o, a, q),
    "EQUIVALENCE": lambda o, a, q, s: equivalence_loss(o, a, q),
}
RISKS = {"UNIQUENESS": lambda o, a, q, s: reidentification_risk(a, q), "GLOBAL": lambda o, a, q, s: global_risk(a, q)}
MODELS = {
    "K_ANONYMITY": lambda o, a, q, s: k_anonymity(a, q),
    "L_DISTINCT": lambda o, a, q, s: l_diversity(a, q, s),
    "L_ENTROPY": lambda o, a, q, s: l_diversity(a, q, s, "ENTROPY"),
    "T_CLOSENESS": lambda o, a, q, s: t_closeness(a, q, s),
}


def check(original: DataFrame, anonymous: DataFrame, quasi: list[ColumnRef], sensitive: ColumnRef | None = None, *, loss: str = "AECS", risk: str = "UNIQUENESS", model: str = "K_ANONYMITY") -> DataFrame:
    """Loss, risk and anonymity of an anonymised table in one row (loss, risk, anonymity)."""
    for kind, known in ((loss, LOSSES), (risk, RISKS), (model, MODELS)):
        if kind not in known:
            raise ValidationError(f"unknown measure {kind!r}; known: {sorted(known)}")
    if sensitive is None and not model.startswith("K"):
        raise ValidationError(f"{model} needs a sensitive column")
    values = []
    for name, made in (("loss", LOSSES[loss]), ("risk", RISKS[risk]), ("anonymity", MODELS[model])):
        one = made(original, anonymous, quasi, sensitive)
        values.append(one.select(col(one.columns[0]).cast("double")).scalar().alias(name))
    return original.sparkSession.range(1).select(*values)


def checked(op: Op, quasi: list[ColumnRef], sensitive: ColumnRef | None = None, **measures: str) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """An anonymising operator that also returns its check: df to (anonymous table, one-row check)."""

    def run(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        out = op(df)
        return out, check(df, out, quasi, sensitive, **measures)

    return run
