"""Registered queries read their tables whole: compared with statements over the whole tables."""

import random
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rillwork.errors import ValidationError
from rillwork.operators import joins, learn
from rillwork.plans.queries import _daily
from rillwork.session import use_checkpoints

QUERIES = entry.queries()
_DAILY = "(select datediff('day', date '1992-01-01', cast(o_orderdate as date)) as day, round(sum(o_totalprice), 2) as total from orders group by 1)"
_NEAR = f"(select g.day, p.day as pd, p.total as pt, n.day as nd, n.total as nt from (select cast(unnest(generate_series(min(day), max(day), 3)) as int) as day from {_DAILY}) g asof join {_DAILY} p on g.day >= p.day asof join {_DAILY} n on g.day <= n.day)"

DAILY = {
    "interpolate_linear": f"select day, round(case when pd = nd then pt else pt + (day - pd) * (nt - pt) / (nd - pd) end + 1e-9, 4) as total from {_NEAR}",
    "interpolate_previous": f"select day, round(pt + 1e-9, 4) as total from {_NEAR}",
    "interpolate_nearest": f"select day, round(case when day - pd <= nd - day then pt else nt end + 1e-9, 4) as total from {_NEAR}",
    "time_sync": f"""with d as (select * from {_DAILY}), g as (select cast(unnest(generate_series(min(day), max(day), 2)) as int) as g from d), h as (select cast(unnest(generate_series(min(day) + 2, max(day) + 2, 2)) as int) as g from d)
      select g as time, round(x.total, 2) as total, round(-y.total, 2) as total_right from (select g from g join h using (g)) asof join d x on g >= x.day asof join (select day + 2 as day, total from d) y on g >= y.day""",
}

_ALL = "c_custkey, c_nationkey, o_orderkey, o_custkey"
JOINS = {f"join_{n}": f"select {c} from customer {n} join orders on c_custkey = o_custkey" for n, c in {"inner": _ALL, "left": _ALL, "right": _ALL, "full": _ALL, "semi": "c_custkey, c_nationkey", "anti": "c_custkey, c_nationkey"}.items()}
SETS = {n: f"select s_nationkey from supplier {n.replace('_', ' ')} select c_nationkey from customer" for n in ("union_all", "union", "intersect", "except")}


def same(spark, sf, name, sql):
    con = duckdb.connect()
    for t in ("orders", "customer", "supplier"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    res = con.execute(sql)
    columns = [c[0] for c in res.description]
    want = sorted(res.fetchall(), key=repr)
    got = sorted((tuple(r) for r in QUERIES[name](spark, sf).select(*columns).collect()), key=repr)
    assert got == want
    return len(got)


@pytest.mark.parametrize("name", DAILY)
def test_daily_totals(name, spark, sf):
    same(spark, sf, name, DAILY[name])


def test_daily_covers_all_orders_and_has_gaps(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{sf}/orders.parquet'")
    want = con.execute(f"select day, total from {_DAILY} order by 1").fetchall()
    assert [tuple(r) for r in _daily(spark, sf).orderBy("day").collect()] == want
    assert len(want) < want[-1][0] - want[0][0] + 1


@pytest.mark.parametrize("name", [*JOINS, *SETS])
def test_joins_and_sets(name, spark, sf):
    same(spark, sf, name, (JOINS | SETS)[name])


def test_outer_rows_of_joins(spark, tmp_path):
    """Customers without orders and orders without customers, which the tables hardly have."""
    con = duckdb.connect()
    con.execute(f"copy (select * from (values (1, 7), (2, 8), (3, 9)) t(c_custkey, c_nationkey)) to '{tmp_path}/customer.parquet'")
    con.execute(f"copy (select * from (values (1, 1), (2, 1), (3, 3), (4, 5)) t(o_orderkey, o_custkey)) to '{tmp_path}/orders.parquet'")
    con.execute(f"copy (select * from (values (4), (5)) t(s_nationkey)) to '{tmp_path}/supplier.parquet'")
    assert {n: same(spark, tmp_path, n, q) for n, q in JOINS.items()} == {"join_inner": 3, "join_left": 4, "join_right": 4, "join_full": 5, "join_semi": 2, "join_anti": 1}


def test_dbscan_refuses_to_stop_early(spark):
    chain = spark.createDataFrame([(i, float(i)) for i in range(9)], "id int, x double")
    with pytest.raises(ValidationError):
        learn.dbscan(1.0, 2, "id", max_rounds=1)(chain)


def brute_dbscan(points: list[tuple], eps: float, least: int) -> dict[int, int]:
    near = {i: [j for j, y in points if sum((abs(u - v) for u, v in zip(x, y, strict=True)), 0.0) <= eps] for i, x in points}
    core, label = {i for i in near if len(near[i]) >= least}, {}
    for i in sorted(core):
        todo = [] if i in label else [i]
        while todo:
            if (j := todo.pop()) not in label:
                label[j] = i
                todo += [k for k in near[j] if k in core]
    number = {x: n for n, x in enumerate(sorted(set(label.values())), 1)}
    return {i: number[label[i]] if i in core else min((number[label[j]] for j in near[i] if j in core), default=0) for i in near}


def test_dbscan_long_chains_take_few_rounds(spark):
    # a label that moves one point a round needs as many rounds as the chain is long, and the driver keeps a plan for each
    ids = random.Random(5).sample(range(150), 150)
    chain = spark.createDataFrame([(i, float(x)) for x, i in enumerate(ids)], "id int, x double")
    assert {r.CLUSTER for r in learn.dbscan(1.0, 2, "id", max_rounds=4)(chain).collect()} == {1}


def test_dbscan_against_brute_force(spark):
    draw = random.Random(3)
    for eps, least, high in ((0.3, 4, 4.0), (2.0, 3, 30.0), (0.1, 2, 1.0)):
        points = [(i, (round(draw.uniform(-high, high), 1), float(draw.randint(0, 4)) * eps)) for i in range(150)]
        df = spark.createDataFrame([(i, *x) for i, x in points], "id int, x double, y double")
        assert {r.id: r.CLUSTER for r in learn.dbscan(eps, least, "id")(df).collect()} == brute_dbscan(points, eps, least)
    odd = spark.createDataFrame([(1, float("inf")), (2, float("inf")), (3, float("nan")), (4, None), (5, 0.0), (6, 0.5)], "id int, x double")
    assert {r.id: r.CLUSTER for r in learn.dbscan(1.0, 2, "id")(odd).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1}


def test_components_over_several_tasks(spark):
    use_checkpoints(spark)
    draw = random.Random(8)
    pairs = [tuple(draw.sample(range(300), 2)) for _ in range(220)] + [(999, i) for i in range(900, 930)]
    label = {x: x for pair in pairs for x in pair}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = spark.createDataFrame([(x, x) for x in label], "node long, a long")
    steps = learn.connected(spark.createDataFrame(pairs, "a long, b long"), most=40)
    for step in steps:
        got = got.join(step, "a", "left").selectExpr("node", "coalesce(l, a) as a")
    parts = lambda of: {frozenset(x for x in of if of[x] == k) for k in of.values()}
    assert len(steps) > 1 and parts({r.node: r.a for r in got.collect()}) == parts(label)


def test_range_join_narrow_ranges_meet_few_rows(spark):
    # 200,000 x 200,000 rows in one bucket of the given width; stopped after a minute
    left = spark.range(200_000).selectExpr("id", "id * 0.125D as v")
    right = spark.range(200_000).selectExpr("id as r", "id * 0.125D as low", "id * 0.125D + 0.1 as high")
    context = spark.sparkContext
    context.setJobGroup("narrow", "range join")
    stop = threading.Timer(60, context.cancelJobGroup, ["narrow"])
    stop.start()
    try:
        assert joins.join_range(None, "v", "low", "high", 50_000)(left, right).count() == 200_000
    finally:
        stop.cancel()
        context.setJobGroup("", "")
    assert joins._merged({}) == [] and joins._merged({0: 5, 1: 9, 7: 2}, 6) == [0, 1, 7] and joins._merged({0: 1, 1: 1, 2: 50}, 2) == [0, 2]


def test_range_join_of_all_lengths(spark):
    draw, inf, nan = random.Random(4), float("inf"), float("nan")
    values = [(i, draw.choice((1, 100, 1e6)) * draw.uniform(-1, 1) // 0.1 * 0.1) for i in range(300)] + [(300, inf), (301, -inf), (302, nan), (303, 0.0), (304, -0.0), (305, None), (306, 1e300)]
    ranges = [(i, x, x + draw.choice((0.0, 1e-9, 0.1, 0.3, 1.0, 8.0, 1e3, 1e5, 3e6))) for i, (_, x) in enumerate(values[:200])]
    ranges += [(400, 0.0, 0.0), (401, -inf, inf), (402, 5.0, inf), (403, -inf, -5.0), (404, 7.0, nan), (405, nan, nan), (406, 2.0, 1.0), (407, None, 1.0), (408, 1.0, None), (409, inf, inf), (410, -1.7e308, 1.7e308), (411, 0.0, 5e-324)]
    a = spark.createDataFrame([(i, i % 2, v) for i, v in values], "i int, k int, v double")
    b = spark.createDataFrame([(j, j % 2, x, y) for j, x, y in ranges], "j int, k int, lo double, hi double")
    plain = a.withColumnRenamed("k", "k1").join(b, (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    for key, want in ((None, plain), ("k", plain.where("k = k1"))):
        got = joins.join_range(key, "v", "lo", "hi", 10)(a if key else a.drop("k"), b).select("i", "j").collect()
        assert len(got) > 400 and sorted(got) == sorted(want.select("i", "j").collect())
