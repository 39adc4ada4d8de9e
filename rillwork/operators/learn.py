"""Regression, clustering, classification and prediction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ColumnRef, col, is_numeric, name_of, names_of
from ..errors import ValidationError
from ..registry import Op, operator
from ..session import use_checkpoints
from .features import assemble, require_numeric

#: The links that each family allows.
LINKS = {
    "GAUSSIAN": ("IDENTITY", "LOG", "INVERSE"), "BINOMIAL": ("LOGIT", "PROBIT", "CLOGLOG"),
    "POISSON": ("LOG", "IDENTITY", "SQRT"), "GAMMA": ("INVERSE", "IDENTITY", "LOG"),
}


def _weights(df: DataFrame, features: list[str], coefficients) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, float(w)) for c, w in zip(features, coefficients, strict=True)], "attribute string, weight double")


def _features(df: DataFrame, label: str) -> list[str]:
    features = [c for c in df.columns if c != label]
    require_numeric(df, features)
    return features


@operator("linear_regression")
def linear_regression(label: str, reg: float = 0.0, elastic_net: float = 0.0, max_iter: int = 100, tolerance: float = 1e-6) -> Op:
    """(attribute, weight) of a least-squares fit."""
    from pyspark.ml.regression import LinearRegression

    def run(df: DataFrame) -> DataFrame:
        y = name_of(df, label)
        features = _features(df, y)
        model = LinearRegression(featuresCol="__x", labelCol=y, regParam=reg, elasticNetParam=elastic_net, maxIter=max_iter, tol=tolerance).fit(assemble(df, features, "__x", "skip"))
        return _weights(df, features, model.coefficients)

    return run


@operator("generalized_regression")
def generalized_regression(label: str, family: str = "GAUSSIAN", link: str = "IDENTITY", max_iter: int = 25) -> Op:
    """(attribute, weight) of a generalised linear model."""
    from pyspark.ml.regression import GeneralizedLinearRegression

    if link not in LINKS.get(family, ()):
        raise ValidationError(f"{family} has no link {link}")

    def run(df: DataFrame) -> DataFrame:
        y = name_of(df, label)
        features = _features(df, y)
        model = GeneralizedLinearRegression(featuresCol="__x", labelCol=y, family=family.lower(), link=link.lower(), maxIter=max_iter).fit(assemble(df, features, "__x", "skip"))
        return _weights(df, features, model.coefficients)

    return run


def _numbers(df: DataFrame, columns: list[ColumnRef] | None) -> list[str]:
    chosen = names_of(df, columns) if columns else [c for c in df.columns if is_numeric(df, c)]
    require_numeric(df, chosen)
    return chosen


@operator("kmeans")
def kmeans(k: int = 2, max_iter: int = 100, seed: int = 0, columns: list[ColumnRef] | None = None, name: str = "CLUSTER") -> Op:
    from pyspark.ml.clustering import KMeans

    def run(df: DataFrame) -> DataFrame:
        made = KMeans(k=k, maxIter=max_iter, featuresCol="__x", predictionCol=name, **({"seed": seed} if seed else {}))
        data = assemble(df, _numbers(df, columns), "__x")
        return made.fit(data).transform(data).drop("__x")

    return run


@operator("gaussian_mixture")
def gaussian_mixture(k: int = 2, max_iter: int = 100, seed: int = 7, columns: list[ColumnRef] | None = None, name: str = "cluster") -> Op:
    from pyspark.ml.clustering import GaussianMixture

    def run(df: DataFrame) -> DataFrame:
        data = assemble(df, _numbers(df, columns), "__x")
        return GaussianMixture(k=k, maxIter=max_iter, seed=seed, featuresCol="__x", predictionCol=name, probabilityCol="__p").fit(data).transform(data).drop("__x", "__p")

    return run


def _nearest(point, medoids: list[list[float]]):
    """(distance, index) of the nearest medoid by Manhattan distance; k literals, no join."""
    each = [F.struct(sum((F.abs(c - v) for c, v in zip(point, m, strict=True)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, m in enumerate(medoids)]
    return F.array_min(F.array(*each))


@operator("kmedoids")
def kmedoids(k: int = 2, max_iter: int = 20, seed: int = 7, columns: list[ColumnRef] | None = None, candidates: int = 16, name: str = "CLUSTER") -> Op:
    """Medoids by Manhattan distance: from a random start, each medoid in turn is swapped with drawn rows if that
    lowers the total distance. All candidates of a round are costed in one pass over all rows."""

    def run(df: DataFrame) -> DataFrame:
        chosen = _numbers(df, columns)
        point = [col(c).cast("double") for c in chosen]
        data = df.select(*(p.alias(c) for p, c in zip(point, chosen, strict=True))).na.drop().persist()
        try:
            drawn = [list(r)[:-1] for r in data.select("*", F.rand(seed).alias("__r")).orderBy("__r", *chosen).limit(k + candidates * max_iter).collect()]
            distinct = list(dict.fromkeys(map(tuple, drawn)))
            medoids, pool = [list(m) for m in distinct[:k]], [list(m) for m in distinct[k:]]
            if len(medoids) < k:
                raise ValidationError(f"fewer than {k} different rows")
            cost = lambda m: F.sum(_nearest([F.col(f"`{c}`") for c in chosen], m)["d"])
            best = data.agg(cost(medoids)).first()[0]
            for i in range(max_iter):
                part = pool[i * candidates : (i + 1) * candidates]
                if not part:
                    break
                trials = [medoids[:j] + [p] + medoids[j + 1 :] for p in part for j in range(k)]
                costs = data.agg(*(cost(t).alias(str(n)) for n, t in enumerate(trials))).first()
                low = min(range(len(trials)), key=lambda n: costs[n])
                if costs[low] < best:
                    best, medoids = costs[low], trials[low]
        finally:
            data.unpersist()
        return df.withColumn(name, _nearest(point, medoids)["i"])

    return run


#: Edges that one task joins into trees.
TREE_EDGES = 1_000_000


def trees(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and for each the least node it is connected with. The roots of an edge's ends are
    hooked to the lesser one and all paths are then made flat, so that rounds grow with the logarithm of a chain's length."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        apart = low != high
        i, j = i[apart], j[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _tree_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    all_edges = list(frames)
    if all_edges:
        nodes, roots = trees(*(np.concatenate([f[c].to_numpy() for f in all_edges]) for c in ("a", "b")))
        yield pd.DataFrame({"a": nodes, "r": roots})


def connected(edges: DataFrame, max_rounds: int | None = None, most: int | None = None) -> list[DataFrame]:
    """Steps (a, l) that lead, one after the other, from a node of the edges (a, b) to one node of its component.

    Each task joins up to `most` edges into trees; the roots at which a node stands in several trees are the edges of the
    next round, so one round is enough up to `most` edges. `max_rounds` makes it an error if a node still moves in that round."""
    most, steps = most or TREE_EDGES, []
    edges = edges.checkpoint()
    while n := edges.count():
        parts = -(-n // most)
        apart = edges.repartitionByRange(parts, "a", "b") if parts > 1 else edges.coalesce(1)
        stood = apart.mapInPandas(_tree_frames, "a long, r long").checkpoint()
        steps.append(stood.groupBy("a").agg(F.min("r").alias("l")))
        if max_rounds is not None and len(steps) >= max_rounds:
            raise ValidationError(f"labels still move after {max_rounds} rounds")
        if parts == 1:
            break
        edges = stood.join(steps[-1], "a").where("r <> l").select(F.col("r").alias("a"), F.col("l").alias("b")).distinct().checkpoint()
    return steps


@operator("dbscan")
def dbscan(eps: float, min_points: int, id_column: ColumnRef, columns: list[ColumnRef] | None = None, name: str = "CLUSTER", max_rounds: int | None = None) -> Op:
    """Density clusters by Manhattan distance <= eps; 0 is noise, clusters are numbered by their least id.

    Neighbours are found inside grid cells of width eps (practical in few dimensions). Equal points are one
    point with a weight, so copies cost nothing. Points of a cell so small that all are neighbours are one node, and if they
    are `min_points` they are core points unseen. Nodes are joined into clusters by `connected`."""

    def run(df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        use_checkpoints(spark)
        key = name_of(df, id_column)
        chosen = _numbers(df.drop(key), columns) if columns is None else _numbers(df, columns)
        dims = [f"__d{i}" for i in range(len(chosen))]
        grid = [f"g{i}" for i in range(len(dims))]

        def near(a: DataFrame, b: DataFrame, kept: list[str]) -> DataFrame:
            """The columns `kept` of the pairs within eps. Cells are a little wider than eps, as quotients are rounded."""
            at = lambda d: F.floor(F.col(d) / (1.01 * eps)).cast("double")
            a = a.withColumns(dict(zip(grid, map(at, dims), strict=True)))
            for g in grid:
                a = a.withColumn(g, F.explode(F.array_distinct(F.array(*(F.col(g) + o for o in (-1, 0, 1))))))
            b = b.withColumns(dict(zip(grid, map(at, dims), strict=True))).withColumnsRenamed({d: f"b{d}" for d in dims})
            far = sum((F.abs(F.col(d) - F.col(f"b{d}")) for d in dims), F.lit(0.0))
            return a.join(b, grid).where(far <= eps).select(*kept)

        points = df.select(col(key).alias("__id"), *(col(c).cast("double").alias(d) for c, d in zip(chosen, dims, strict=True))).na.drop()
        for d in dims:
            points = points.where(F.abs(d) < float("inf"))  # others are near nothing
        groups = points.groupBy(*dims).agg(F.min("__id").alias("p"), F.count("*").alias("w"))
        cell = Window.partitionBy(*(F.floor(F.col(d) * len(dims) / eps) for d in dims))
        extent = sum((F.max(d).over(cell) - F.min(d).over(cell) for d in dims), F.lit(0.0))
        placed = groups.withColumns({"whole": extent <= eps, "first": F.min("p").over(cell), "in_cell": F.sum("w").over(cell)})
        placed = placed.select(*dims, "p", "w", F.when(F.col("whole"), F.col("first")).otherwise(F.col("p")).alias("s"), (F.col("whole") & (F.col("in_cell") >= min_points)).alias("sure")).checkpoint()
        counts = near(placed.where("not sure").select("p", *dims), placed.select("w", *dims), ["p", "w"]).groupBy("p").agg(F.sum("w").alias("n"))
        found = counts.where(F.col("n") >= min_points).select("p").checkpoint()
        core = placed.where("sure").unionByName(placed.where("not sure").join(found, "p", "left_semi")).select("p", "s", *dims)
        # numbers of nodes go by place, so that a task's edges are those of a region
        nodes = core.groupBy("s").agg(F.min("p").alias("least"), *(F.min(d).alias(d) for d in dims)).repartitionByRange(*dims).sortWithinPartitions(*dims)
        nodes = nodes.select("s", "least", F.monotonically_increasing_id().alias("a")).checkpoint()
        ends = core.join(nodes, "s").select("a", *dims)
        steps = connected(near(ends, ends.withColumnRenamed("a", "b"), ["a", "b"]).where("a < b").distinct(), max_rounds)
        label = nodes
        for step in steps:
            label = label.join(step, "a", "left").withColumn("a", F.coalesce("l", "a")).drop("l")
        label = label.checkpoint()
        least = label.groupBy("a").agg(F.min("least").alias("l"))
        from .project import numbered

        order = numbered(least, ["l"], "n").select("a", F.col("n").cast("int").alias("__n"))
        known = core.join(label.join(order, "a").select("s", "__n"), "s").select("p", "__n", *dims).checkpoint()
        rest = placed.where("not sure").join(found, "p", "left_anti").select("p", *dims)
        touched = near(rest, known.select("__n", *dims), [*dims, "__n"]).groupBy(*dims).agg(F.min("__n").alias("__n"))
        per_group = known.select(*dims, "__n").unionByName(touched)
        on = [col(c).cast("double").eqNullSafe(per_group[d]) for c, d in zip(chosen, dims, strict=True)]
        return df.join(per_group, on, "left").select(*map(col, df.columns), F.coalesce("__n", F.lit(0)).alias(name))

    return run


def link_clusters(points: np.ndarray, k: int, link: str) -> np.ndarray:
    """Cluster numbers of rows, merged from single rows to k clusters by Manhattan distance."""
    n = len(points)
    d = np.abs(points[:, None, :] - points[None, :, :]).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), n
    while alive > k:
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        merged = {"SINGLE": np.minimum(d[i], d[j]), "COMPLETE": np.maximum(d[i], d[j]), "AVERAGE": (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])}[link]
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        alive -= 1
    return np.unique(label, return_inverse=True)[1]


def _widest_gaps(values: DataFrame, c: str, k: int) -> list[float]:
    """The numbers behind the k widest gaps between neighbouring different values; of equal gaps the last ones."""
    from .project import numbered

    order = numbered(values.select(col(c).cast("double").alias("v")).distinct(), ["v"], "n")
    before = order.select((F.col("n") + 1).alias("n"), F.col("v").alias("before"))
    gaps = order.join(before, "n").select("v", (F.col("v") - F.col("before")).alias("gap"))
    return sorted(r.v for r in gaps.orderBy(F.desc("gap"), F.desc("v")).limit(k).collect())


@operator("agglomerative")
def agglomerative(clusters: int, link: str = "SINGLE", columns: list[ColumnRef] | None = None, groups: list[ColumnRef] = (), most_rows: int = 3_000, name: str = "CLUSTER") -> Op:
    """Hierarchical clustering per group (or of the whole table) by Manhattan distance; equal rows are one.

    SINGLE on one column of a whole table parts it at its widest gaps, whatever its size. Elsewhere the
    method needs all pairs, so a group of more than `most_rows` different rows is refused rather than cut."""

    def run(df: DataFrame) -> DataFrame:
        by = names_of(df, groups)
        chosen = [c for c in _numbers(df, columns) if c not in by]
        if link == "SINGLE" and len(chosen) == 1 and not by:
            cuts = _widest_gaps(df.na.drop(subset=chosen), chosen[0], clusters - 1)
            number = sum((F.when(col(chosen[0]) >= cut, 1).otherwise(0) for cut in cuts), F.lit(0))
            return df.withColumn(name, F.when(col(chosen[0]).isNotNull(), number).cast("int"))
        distinct = df.select(*map(col, by), *map(col, chosen)).na.drop(subset=chosen).distinct()
        largest = distinct.groupBy(*map(col, by)).count().agg(F.max("count")).first()[0] or 0
        if largest > most_rows:
            raise ValidationError(f"a group has {largest} different rows, more than {most_rows}")

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(chosen, ignore_index=True)
            return pdf.assign(**{name: link_clusters(pdf[chosen].to_numpy(float), clusters, link).astype("int32")})

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema.fields) + f", `{name}` int"
        grouped = distinct.groupBy(*map(col, by)) if by else distinct.withColumn("__all", F.lit(0)).groupBy("__all")
        made = grouped.applyInPandas(lambda pdf: one(pdf.drop(columns="__all", errors="ignore")), schema)
        return df.join(made, [*by, *chosen], "left")

    return run


@operator("random_forest_train")
def random_forest_train(label: str, model_path: str, features: list[ColumnRef] | None = None, folds: int = 3, trees: list[int] = (20,), depths: list[int] = (5,), bins: list[int] = (32,), impurities: list[str] = ("gini",), subsets: list[str] = ("auto",), seed: int = 7) -> Op:
    """Grid search with cross validation on 80 % of the rows; the best pipeline is saved and the rest predicted (columns label, predicted)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    def run(df: DataFrame) -> DataFrame:
        y = name_of(df, label)
        chosen = names_of(df, features) if features else [c for c in df.columns if c != y]
        require_numeric(df, chosen)
        train, test = df.randomSplit([0.8, 0.2], seed)
        index = StringIndexer(inputCol=y, outputCol="__y", handleInvalid="keep")
        labels = index.fit(df).labels
        forest = RandomForestClassifier(featuresCol="__x", labelCol="__y", predictionCol="__p", probabilityCol="__q", rawPredictionCol="__r", seed=seed)
        stages = [index, VectorAssembler(inputCols=chosen, outputCol="__x", handleInvalid="skip"), forest, IndexToString(inputCol="__p", outputCol="predicted", labels=labels)]
        grid = ParamGridBuilder().addGrid(forest.numTrees, list(trees)).addGrid(forest.maxDepth, list(depths)).addGrid(forest.maxBins, list(bins)).addGrid(forest.impurity, list(impurities)).addGrid(forest.featureSubsetStrategy, list(subsets)).build()
        judge = MulticlassClassificationEvaluator(labelCol="__y", predictionCol="__p", metricName="f1")
        best = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=grid, evaluator=judge, numFolds=folds if folds >= 2 else 3, seed=seed).fit(train).bestModel
        best.write().overwrite().save(model_path)
        return best.transform(test).select(*map(col, df.columns), "predicted")

    return run


def latest_model(df: DataFrame, path: str) -> str:
    """The greatest number among the names of a folder's folders, on any file system that Spark reads."""
    jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
    folder = jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(context.hadoopConfiguration()).listStatus(folder) if s.isDirectory()]
    numbers = [n for n in names if n.isdigit()]
    if not numbers:
        raise ValidationError(f"{path} holds no numbered model")
    return max(numbers, key=int)


@operator("model_predict")
def model_predict(model_path: str, labels: list[str] | None = None, drop: str = "__", model_id: int | str | None = None, assemble: list[str] | None = None) -> Op:
    """Apply a saved pipeline; `labels` names columns `probability(<label>)` taken from its probability vector.

    `model_id` names a folder below `model_path`; "LATEST" takes the one with the greatest number as its name. `assemble`
    puts the named columns (or, where empty, all numeric ones) into a vector `features` first; a table in which one of them is missing goes to
    the model as it is."""

    def run(df: DataFrame) -> DataFrame:
        path = model_path if model_id is None else f"{model_path}/{latest_model(df, model_path) if str(model_id) == 'LATEST' else model_id}"
        ready = df
        if assemble is not None and "features" not in df.columns:
            chosen = list(assemble) or [c for c in df.columns if is_numeric(df, c)]
            if chosen and set(chosen) <= set(df.columns):
                from pyspark.ml.feature import VectorAssembler

                ready = VectorAssembler(inputCols=chosen, outputCol="features", handleInvalid="keep").transform(df)
        out = PipelineModel.load(path).transform(ready)
        if labels:
            vector = next(c for c in out.columns if c in ("probability", "__q"))
            arr = vector_to_array(col(vector))
            out = out.select("*", *(F.get(arr, F.lit(i)).alias(f"probability({v})") for i, v in enumerate(labels)))
        return out.drop(*(c for c in out.columns if drop and c.startswith(drop) and c not in df.columns))

    return run


@operator("batch_predict")
def batch_predict(predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str, setup: Callable[[], object] | None = None) -> Op:
    """Rows through a function of one's own in Arrow batches, e.g. a model or a client of a model server.
    `setup` runs once per task and its result is passed to `predict` as a second argument."""

    def run(df: DataFrame) -> DataFrame:
        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = setup() if setup else None
            for pdf in frames:
                yield predict(pdf, state) if setup else predict(pdf)

        return df.mapInPandas(each, schema)

    return run
