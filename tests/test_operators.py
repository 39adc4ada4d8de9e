"""Operators on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from rillwork.errors import ProcessError, ValidationError
from rillwork.operators import aggregate, clean, features, filters, joins, learn, project, ranks, rows, timeseries
from rillwork.registry import build, operator, operators

# Inputs and answers that other implementations of these operators are tested with.
WEATHER = [
    ("no", "sunny", 85, 85, False), ("no", "sunny", 80, 90, True), ("yes", "overcast", 83, 78, False), ("yes", "rain", 70, 96, False), ("yes", "rain", 68, 80, False),
    ("no", "rain", 65, 70, True), ("yes", "overcast", 64, 65, True), ("no", "sunny", 72, 95, False), ("yes", "sunny", 69, 70, False), ("yes", "rain", 75, 80, False),
    ("yes", "sunny", 75, 70, True), ("yes", "overcast", 72, 90, True), ("yes", "overcast", 81, 75, False), ("no", "rain", 71, 80, True),
]
REGRESSION = [
    (88.01632464, 0.636574028, 8.442168148, 2.116099574, 2.771867529, 8.448426549), (138.7548543, 4.595454155, 4.388041662, 4.926093835, 2.682403955, 8.617751819),
    (38.28387155, 4.292060076, 0.861090232, 9.15798394, 6.607498138, 4.084605081), (82.14778398, 8.559949469, 3.856237673, 1.0381353, 1.687798024, 2.8930632),
    (33.79002054, 2.272320698, 1.834078721, 6.300620501, 1.93796937, 2.069888374), (7.38866956, 3.956280442, 0.34429275, 4.337370526, 7.563450458, 8.591228627),
    (191.4532705, 2.220060635, 7.843024669, 6.462687043, 8.731893832, 9.28188111), (15.34906002, 6.105141656, 1.074919676, 1.162823303, 9.241172289, 7.23885872),
    (97.40527838, 2.691071171, 3.571957641, 7.805965771, 6.843146634, 3.053870888), (111.4973958, 4.262579387, 7.369277727, 0.820670523, 6.687792013, 3.976156809),
]
POINTS20 = [
    (6.848934849, 3.158069218), (-0.943968337, 22.91433149), (-1.175376171, 23.9929549), (-0.728804819, 23.59998941), (-0.554106973, 23.14728525), (-0.50858251, 23.55578863), (-0.655966008, 24.12991918),
    (-0.828753893, 23.06295102), (-0.906446078, 23.63442066), (-1.175471759, 23.23088862), (-0.586424383, 23.56802483), (6.029774804, 3.337247273), (-1.022162431, 23.21138139), (-0.665984656, 23.20667453),
    (-0.578946901, 23.40512492), (-0.45042623, 23.88963325), (-0.639808699, 23.55207991), (-0.971141606, 23.10933188), (-0.866241774, 22.74841298), (-0.751035994, 22.83455997),
]
POINTS10 = [(2, 6), (3, 4), (3, 8), (4, 7), (6, 2), (6, 4), (7, 3), (7, 4), (8, 5), (7, 6)]
SCORES8 = [(91.5775, 81.572, 84, 73.2035, 79.5918), (83.4467, 72.9477, 92, 60.6273, 75.1917), (47.0239, 51.3076, 31, 25.807, 36.0382), (69.9559, 61.0005, 76, 76.643, 71.2145), (57.2462, 53.9258, 79, 65.2266, 66.0508), (42.8488, 46.1728, 7, 31.9797, 28.3842), (73.7949, 64.0751, 98, 61.2696, 74.4483), (22.4626, 31.7166, 6, 28.549, 22.0886)]
WORDS = [("I", 1), ("am", 1), ("so", 3), ("happy", 4), ("now", 2), ("are", 3), ("you", 2), ("happy", 6), ("now", 8), ("I", 1), ("I", 3), ("I", 10)]


def weather(spark):
    return spark.createDataFrame(WEATHER, "play string, outlook string, temperature long, humidity long, wind boolean")


def values(df):
    return [tuple(r) for r in df.collect()]


def test_aggregate_golden(spark):
    op = aggregate.aggregate([("temperature", "AVERAGE"), ("humidity", "SUM"), ("outlook", "CONCATENATION"), ("temperature", "COUNT")], ["outlook", "play"])
    assert values(op(weather(spark))) == [
        ("overcast", "yes", 75.0, 308, "|".join(["overcast"] * 4), 4), ("rain", "no", 68.0, 150, "rain|rain", 2), ("rain", "yes", 71.0, 256, "rain|rain|rain", 3),
        ("sunny", "no", 79.0, 270, "sunny|sunny|sunny", 3), ("sunny", "yes", 72.0, 140, "sunny|sunny", 2),
    ]
    with pytest.raises(ValidationError):
        aggregate.aggregate([("outlook", "SUM")], ["play"])(weather(spark))


def test_filter_golden(spark):
    df = spark.createDataFrame(WORDS, "word string, count int")
    assert filters.filter_rows("count", "LESS_THAN", 8)(df).count() == 10
    assert filters.filter_rows("count", "EQUAL", 1)(df).count() == 3
    assert filters.filter_rows("word", "EXIST", pattern="app")(df).count() == 2
    assert filters.filter_groups("word", "LARGE_THAN", 14, "SUM", "count")(df).count() == 4
    with pytest.raises(ValidationError):
        filters.filter_rows("count", "NEAR")


def test_bins_golden(spark):
    depth = spark.createDataFrame([(v,) for v in (0, 4, 12, 16, 16, 18, 18, 18, 28)], "v int")
    got = [r.v_result for r in clean.equal_depth_bins([0], 3)(depth).orderBy("v").collect()]
    assert got == ["range1[-Infinity-14.000000]"] * 3 + ["range2[14.000000-23.000000]"] * 5 + ["range3[23.000000-Infinity]"]
    width = spark.createDataFrame([(v,) for v in (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14)], "v int")
    got = [r.v for r in clean.equal_width_bins(["v"], 4, "VALUE_CHANGE")(width).collect()]
    assert got[2:4] == ["range1[-Infinity-5.000000]", "range2[5.000000-8.000000]"] and got[-1] == "range4[11.000000-Infinity]"
    with pytest.raises(ValidationError):
        clean.equal_width_bins(["v"], 4)(width.where("v = 2"))
    spread = spark.range(0, 100_000).selectExpr("case when id % 10 = 9 then null else exp(id / 3000.0) end as v")
    got = clean.equal_depth_bins(["v"], 4)(spread).groupBy("v_result").count().collect()
    assert sorted(r["count"] for r in got if r.v_result) == [22_500] * 4 and {r["count"] for r in got if not r.v_result} == {10_000}
    for rows in ([1] * 50 + [2], [1, 1, 2, 3, 3, 3], [], [7]):
        with pytest.raises(ProcessError):
            clean.equal_depth_bins(["v"], 5)(spark.createDataFrame([(v,) for v in rows], "v int"))


def test_values_at_ranks(spark):
    import random

    rng = random.Random(3)
    for values in ([], [5.0], [1.0, 2.0], [0.0] * 9000 + [1.0], [rng.gauss(0, 1) for _ in range(9001)], [rng.lognormvariate(0, 9) * rng.choice((-1, 1)) for _ in range(9000)], [float(i) for i in range(9000)] + [1e308, -1e308, float("inf"), float("-inf"), float("nan"), None]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        known = sorted(v for v in values if v is not None and v == v)
        n = len(known)
        assert ranks.values_at(df, F.col("v"), lambda n: sorted({0, n // 4, n // 2, n - 1})) == [known[i] for i in sorted({0, n // 4, n // 2, n - 1})] if n else ranks.values_at(df, F.col("v"), lambda n: [0]) == []
        assert ranks.median_of(df, F.col("v")) == (None if not n else known[(n - 1) // 2] / 2 + known[n // 2] / 2)


def test_minmax_and_impute(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    assert [r[0] for r in clean.minmax_scale(["v"], -1, 1)(df).collect()] == [-1.0, -0.5, 0.0, 0.5, 1.0, None]
    assert values(clean.impute("MEDIAN")(df))[-1] == (2.0,)
    assert values(clean.impute("MEAN", ["v"])(df))[-1] == (2.0,)
    assert clean.minmax_scale(["v"])(df.where("v = 3")).first().v == 0.5
    assert clean.minmax_scale(["v"])(df.limit(0)).count() == 0


def test_regressions_golden(spark):
    df = spark.createDataFrame(REGRESSION, "label double, a1 double, a2 double, a3 double, a4 double, a5 double")
    got = [r.weight for r in learn.linear_regression("label", tolerance=0.05)(df).collect()]
    assert got == pytest.approx([14.876713421499904, 22.527385416531974, 13.075232570485753, 0.06384440492653287, 4.089080128867606], abs=1e-8)
    got = [r.weight for r in learn.generalized_regression("label", "GAUSSIAN", "LOG", 10)(df).collect()]
    assert got == pytest.approx([0.20573, 0.32125, 0.19816, -0.05627, 0.00591], abs=1e-4)
    assert features.stepwise_forward("label")(df).columns == ["label", "a2"]
    assert features.stepwise_backward("label")(df).columns == ["label", "a2"]
    with pytest.raises(ValidationError):
        learn.generalized_regression("label", "POISSON", "LOGIT")


def test_clusters_golden(spark):
    scores = spark.createDataFrame(SCORES8, "d1 double, d2 double, d3 int, d4 double, d5 double")
    assert [r.CLUSTER for r in learn.kmeans(2, seed=7)(scores).collect()] in ([0, 0, 1, 0, 0, 1, 0, 1], [1, 1, 0, 1, 1, 0, 1, 0])
    ten = spark.createDataFrame(POINTS10, "x int, y int")
    got = [r.CLUSTER for r in learn.kmedoids(2, 20, 7)(ten).collect()]
    assert len(set(got[:4])) == 1 and len(set(got[4:])) == 1 and got[0] != got[-1]
    assert [r.CLUSTER for r in learn.agglomerative(2, "AVERAGE", ["x", "y"])(ten).orderBy("x", "y").collect()].count(0) in (4, 6)
    twenty = spark.createDataFrame([(i, *p) for i, p in enumerate(POINTS20)], "id int, x double, y double")
    got = {r.id: r.CLUSTER for r in learn.dbscan(0.5, 5, "id")(twenty).collect()}
    assert {i for i, c in got.items() if c == 0} == {0, 2, 6, 11} and set(got.values()) == {0, 1}
    mixed = learn.gaussian_mixture(2, 10, 7)(scores)
    assert {r.cluster for r in mixed.collect()} <= {0, 1}


def test_dbscan_joins_chains_and_keeps_copies(spark):
    chain = [(i, float(i), 0.0) for i in range(30)] + [(100 + i, float(i), 50.0) for i in range(5)] + [(200, 500.0, 0.0), (201, None, 1.0), (202, 3.0, 0.0)]
    got = {r.id: r.CLUSTER for r in learn.dbscan(1.0, 2, "id")(spark.createDataFrame(chain, "id int, x double, y double")).collect()}
    assert {got[i] for i in range(30)} == {1} == {got[202]} and {got[100 + i] for i in range(5)} == {2} and got[200] == got[201] == 0 and len(got) == len(chain)


def test_feature_golden(spark):
    chi = spark.createDataFrame([(1.0, 0.0, 0.0, 18.0, 1.0), (0.0, 0.0, 1.0, 12.0, 0.0), (0.0, 1.0, 0.0, 15.0, 0.1)], "label double, a1 double, a2 double, a3 double, a4 double")
    assert features.chi_square_select("label", 2)(chi).columns == ["a3", "a4"]
    hot = features.one_hot("c")(spark.createDataFrame([("apple",), ("banana",), ("coconut",), ("banana",), ("coconut",)], "c string"))
    assert {r.c: str(r.cVec) for r in hot.collect()} == {"apple": "(2,[],[])", "banana": "(2,[0],[1.0])", "coconut": "(2,[1],[1.0])"}
    assert features.tree_select("play", 20, 0.1, 2, 32)(weather(spark)).columns == ["outlook", "temperature", "wind"]
    assert features.pca(2)(weather(spark).select("temperature", "humidity")).columns == ["pc1", "pc2"]


def test_numbering_is_exact(spark):
    df = spark.range(0, 500, 1, 7).selectExpr("cast((id * 37) % 50 as int) as a", "id")
    got = project.numbered(df, ["a", "id"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 501)) and [(r.a, r.id) for r in got] == sorted((r.a, r.id) for r in got)
    hot = project.numbered(df, ["a", "id"], "n", hot_rows=3).orderBy("n").collect()
    assert [(r.a, r.id, r.n) for r in hot] == [(r.a, r.id, r.n) for r in got]
    back = project.numbered(df, ["a", "id"], "n", descending=True, hot_rows=3).orderBy("n").collect()
    assert [(r.a, r.id) for r in back] == [(r.a, r.id) for r in got][::-1]
    assert filters.drop_last(490, ["a", "id"])(filters.drop_first(3, ["a", "id"])(df)).count() == 7
    assert project.numbered(df.limit(0), ["a"], "n").count() == 0


def test_row_windows(spark):
    df = spark.range(1, 8).toDF("x")
    got = values(rows.sliding_rows(3, ["x"])(df))
    assert len(got) == 5 * 3 and sorted(x for w, x in got if w == 4) == [5, 6, 7]
    assert values(rows.sliding_rows(9, ["x"])(df)) == []
    assert {w for w, _ in values(rows.tumbling_rows(3, ["x"], keep_rest=False)(df))} == {0, 1}


def test_interpolation(spark):
    df = spark.createDataFrame([("a", 0, 0.0, "p"), ("a", 4, 8.0, "q"), ("a", 10, None, "r"), ("b", 5, 1.0, "s")], "k string, i int, v double, t string")
    op = lambda m, **o: {(r.k, r.i): (r.v, r.t) for r in timeseries.interpolate("i", 2, m, partition_by=["k"], **o)(df).collect()}
    linear = op("LINEAR")
    assert [linear["a", i][0] for i in (0, 2, 4, 6)] == [0.0, 4.0, 8.0, None] and linear["b", 5] == (1.0, "s")
    assert op("NEAREST")["a", 2] == (0.0, "p") and op("PREVIOUS")["a", 8] == (8.0, "q")
    for m in ("LINEAR", "NEAREST", "PREVIOUS"):
        assert op(m, segment=1) == op(m)
    assert timeseries.interpolate("i", 2)(df.limit(0).drop("k")).count() == 0
    sync = timeseries.time_synchronize("i", "j", 1, "LINEAR", None)(df.where("k = 'a'").select("i", "v"), spark.createDataFrame([(3, 1.0), (5, 3.0)], "j int, w double"))
    assert {r.time: r.w for r in sync.collect()} == {0: 1.0, 1: 2.0, 2: 3.0}


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, a string")
    b = spark.createDataFrame([(1, 5.0, "l"), (1, 6.0, "m")], "k int, b double, a string")
    assert joins.join_on_key("k", [["a"], ["b"]], "LEFT_OUTER")(a, b).count() == 4
    zipped = values(joins.append_columns([["a"], ["b"]])(a, b))
    assert sorted(zipped, key=str)[0][:2] == (1, "x") and len(zipped) == 3
    assert joins.merge_tables(["CONCAT"])(a, a).count() == 6
    near = joins.join_asof("k", "t", ["v"], 3)(spark.createDataFrame([(1, 5), (1, 1)], "k int, t int"), spark.createDataFrame([(1, 2, "p"), (1, 5, "q")], "k int, t int, v string"))
    assert sorted(values(near), key=str) == [(1, 1, None), (1, 5, "q")]
    moments = spark.sql("select id % 3 as k, id, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 17.3) as t from range(200)")
    other = moments.selectExpr("k", "id as o", "t")
    for kind in ("INNER", "LEFT_OUTER"):
        near = joins.join_interval("k", "t", "90 seconds", kind)(moments, other)
        plain = joins.join_interval("k", "t", "1 minutes 30 seconds", kind)(moments, other)
        assert sorted(map(str, near.collect())) == sorted(map(str, plain.collect()))
    ranged = joins.join_range(None, "t", "lo", "hi", 10)(spark.createDataFrame([(5,), (25,)], "t int"), spark.createDataFrame([(0, 30), (26, 40), (9, 1)], "lo int, hi int"))
    assert sorted(values(ranged)) == [(5, 0, 30), (25, 0, 30)]


def test_reshaping(spark):
    df = spark.createDataFrame([(1, ["a", "b"], (7, "s")), (2, None, None)], "i int, v array<string>, s struct<p:int,q:string>")
    assert project.split_column("v")(df).columns == ["i", "s", "v0", "v1"]
    assert project.split_column("s", keep=True)(df).columns == ["i", "v", "s", "p", "q"]
    assert values(project.explode_column("v", "w")(df).select("w")) == [("a",), ("b",)]
    assert project.explode_column("i")(df).count() == 2
    one = aggregate.transpose("i", ["i"])(df)
    assert (one.columns, values(one)) == (["0", "1"], [(1, 2)])
    envelope = spark.createDataFrame([('{"m2m:sgn":{"nev":{"rep":{"m2m:cin":{"con":"aGk=","cnf":"text/plain:1"}}}}}',), ('{"m2m:sgn":{"nev":{"rep":{"m2m:cin":{"con":"plain"}}}}}',), ("no",)], "m string")
    assert [r.content for r in project.extract_onem2m("m")(envelope).collect()] == ["hi", "plain", None]
    outputs = spark.createDataFrame([(1, ["[1 0]", "[3 2]"]), (2, None)], "i int, o array<string>")
    for method, want in (("SUM", [4.0, 2.0]), ("AVG", [2.0, 1.0]), ("MAX", [3.0, 2.0]), ("MIN", [1.0, 0.0]), ("AND", [1.0, 0.0]), ("OR", [1.0, 1.0])):
        assert [r.output for r in aggregate.ensemble_aggregate("o", method, ["i"])(outputs).collect()] == [want, None]


def test_registry(spark):
    assert len(operators()) > 70
    df = spark.range(3).toDF("x")
    assert build("top_k", column="x", n=1, ascending=False)(df).first().x == 2
    with pytest.raises(ValidationError):
        build("drop_columns", columns=["nope"])(df)
    assert build("drop_columns", strict=False, columns=["nope"])(df) is df
    with pytest.raises(ValidationError):
        build("nope")

    @operator("plus_one")
    def plus_one(column):
        return lambda d: d.withColumn(column, F.col(column) + 1)

    assert [r.x for r in build("plus_one", column="x")(df).collect()] == [1, 2, 3]


def test_single_linkage_of_a_column_is_that_of_all_pairs(spark):
    import random

    rng = random.Random(4)
    values = [float(rng.randint(0, 60)) for _ in range(40)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r.CLUSTER for r in learn.agglomerative(4, "SINGLE")(df).collect()}
    points = sorted({v for v in values if v is not None})
    want = learn.link_clusters(__import__("numpy").array(points)[:, None], 4, "SINGLE")
    assert got == dict(zip(points, want.tolist(), strict=True)) | {None: None}
    assert learn.agglomerative(4, "SINGLE")(df.limit(0)).count() == 0
