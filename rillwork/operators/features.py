"""Vectors, indexes, encodings and feature selection on MLlib."""

from __future__ import annotations

from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import ColumnRef, col, is_numeric, is_text, name_of, names_of
from ..errors import ValidationError
from ..registry import Op, operator


def assemble(df: DataFrame, columns: list[str], name: str, invalid: str = "error") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid=invalid).transform(df)


@operator("vectorize")
def vectorize(name: str, columns: list[ColumnRef] | None = None, keep: bool = True) -> Op:
    """Columns (all if none are given) to one vector."""

    def run(df: DataFrame) -> DataFrame:
        chosen = names_of(df, columns) if columns else df.columns
        out = assemble(df, chosen, name)
        return out if keep else out.drop(*chosen)

    return run


@operator("vectorize_all")
def vectorize_all(name: str) -> Op:
    """All columns as doubles to one more column, a vector."""
    return lambda df: assemble(df.select("*", *(col(c).try_cast("double").alias(f"__{c}") for c in df.columns)), [f"__{c}" for c in df.columns], name, "keep").select(*map(col, df.columns), col(name))


@operator("string_index")
def string_index(pairs: list[tuple[str, str]], invalid: str = "keep") -> Op:
    """Category to its rank by frequency (ties by name); nulls and unseen values get the last index."""
    return lambda df: StringIndexer(inputCols=[a for a, _ in pairs], outputCols=[b for _, b in pairs], handleInvalid=invalid, stringOrderType="frequencyDesc").fit(df).transform(df)


@operator("one_hot")
def one_hot(column: str, drop_last: bool = True) -> Op:
    """`<c>Index` and `<c>Vec`; the last category is the zero vector."""

    def run(df: DataFrame) -> DataFrame:
        c = name_of(df, column)
        indexed = StringIndexer(inputCol=c, outputCol=f"{c}Index").fit(df).transform(df)
        return OneHotEncoder(inputCol=f"{c}Index", outputCol=f"{c}Vec", dropLast=drop_last).fit(indexed).transform(indexed)

    return run


@operator("chi_square_select")
def chi_square_select(label: str, top: int = 1) -> Op:
    """The `top` columns that depend most on the label by chi-square, in their order of appearance."""

    def run(df: DataFrame) -> DataFrame:
        y = name_of(df, label)
        features = [c for c in df.columns if c != y and is_numeric(df, c)]
        selector = UnivariateFeatureSelector(featuresCol="__f", labelCol=y, outputCol="__o", selectionMode="numTopFeatures").setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(top)
        chosen = selector.fit(assemble(df, features, "__f")).selectedFeatures
        return df.select(*(col(features[i]) for i in sorted(chosen)))

    return run


@operator("pca")
def pca(k: int = 2, columns: list[ColumnRef] | None = None) -> Op:
    """Columns, centred, projected on the first k principal components: pc1 to pck."""

    def run(df: DataFrame) -> DataFrame:
        chosen = names_of(df, columns) if columns else [c for c in df.columns if is_numeric(df, c)]
        x = assemble(df.select(*(col(c).cast("double").alias(c) for c in chosen)), chosen, "__f")
        centred = StandardScaler(inputCol="__f", outputCol="__c", withMean=True, withStd=False).fit(x).transform(x)
        out = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred).transform(centred)
        arr = vector_to_array("__p")
        return out.select(*(F.get(arr, F.lit(i)).alias(f"pc{i + 1}") for i in range(k)))

    return run


@operator("tree_select")
def tree_select(label: str, max_depth: int = 5, min_info_gain: float = 0.0, min_instances: int = 1, max_bins: int = 32, impurity: str = "gini", seed: int = 7) -> Op:
    """The columns that a decision tree for the label makes use of, without the label; texts are indexed for the tree."""
    from pyspark.ml.classification import DecisionTreeClassifier

    def run(df: DataFrame) -> DataFrame:
        y = name_of(df, label)
        features = [c for c in df.columns if c != y]
        work, inputs = df, []
        for c in [*features, y]:
            if is_numeric(df, c) and c != y:
                work, name = work.withColumn(f"__{c}", col(c).cast("double")), f"__{c}"
            elif is_text(df, c) or c == y:
                work, name = StringIndexer(inputCol=c, outputCol=f"__{c}", handleInvalid="keep").fit(work.withColumn(c, col(c).cast("string"))).transform(work.withColumn(c, col(c).cast("string"))), f"__{c}"
            else:
                work, name = work.withColumn(f"__{c}", col(c).cast("double")), f"__{c}"
            inputs.append(name)
        tree = DecisionTreeClassifier(featuresCol="__x", labelCol=f"__{y}", maxDepth=max_depth, minInfoGain=min_info_gain, minInstancesPerNode=min_instances, maxBins=max_bins, impurity=impurity, seed=seed)
        model = tree.fit(assemble(work, inputs[:-1], "__x", "skip"))
        weight = model.featureImportances.toArray()
        return df.select(*(col(c) for c, w in zip(features, weight, strict=True) if w > 0))

    return run


def _t_values(df: DataFrame, label: str, features: list[str]) -> list[tuple[float, float]]:
    """(|t|, p) of each feature in a least-squares fit, without the intercept's."""
    from pyspark.ml.regression import LinearRegression

    model = LinearRegression(featuresCol="__x", labelCol=label, solver="normal").fit(assemble(df, features, "__x"))
    return [(abs(t), p) for t, p in zip(model.summary.tValues, model.summary.pValues, strict=True)][: len(features)]


@operator("stepwise_forward")
def stepwise_forward(label: str, p_value: float = 0.01) -> Op:
    """Greedily add the column with the largest |t| whose p is within the limit, until none is. Label first."""

    def run(df: DataFrame) -> DataFrame:
        y = name_of(df, label)
        rest, kept = [c for c in df.columns if c != y and is_numeric(df, c)], []
        data = df.select(y, *rest).persist()
        try:
            while rest:
                scored = [(*_t_values(data, y, [*kept, c])[-1], c) for c in rest]
                fit = [(t, c) for t, p, c in scored if p <= p_value]
                if not fit:
                    break
                best = max(fit)[1]
                kept.append(best)
                rest.remove(best)
        finally:
            data.unpersist()
        return df.select(col(y), *map(col, kept))

    return run


@operator("stepwise_backward")
def stepwise_backward(label: str, p_value: float = 0.01) -> Op:
    """Drop the column with the smallest |t| as long as its p is above the limit. Label first."""

    def run(df: DataFrame) -> DataFrame:
        y = name_of(df, label)
        kept = [c for c in df.columns if c != y and is_numeric(df, c)]
        data = df.select(y, *kept).persist()
        try:
            while kept:
                (t, p), worst = min(zip(_t_values(data, y, kept), kept, strict=True))
                if p <= p_value:
                    break
                kept.remove(worst)
        finally:
            data.unpersist()
        return df.select(col(y), *map(col, kept))

    return run


def require_numeric(df: DataFrame, columns: list[str]) -> None:
    if bad := [c for c in columns if not is_numeric(df, c)]:
        raise ValidationError(f"not numeric: {bad}")
