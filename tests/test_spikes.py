"""Spike detection: the Markov model against brute force, and defined results in odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.quality import missing, spikes
from rillwork.quality import queries as q

COLUMNS = "rec_id long, t long, link_id string, detector_id string, prcs_spd double, prcs_trv_time double"
RULES = missing.MissingRules((), (("prcs_spd", (-1.0,)), ("prcs_trv_time", (9999.0,))))


def brute(emit, start):
    """Forward-backward row by row."""
    n = len(emit)
    a, b = np.zeros_like(emit), np.ones_like(emit)
    for i in range(n):
        a[i] = (spikes.START if start[i] else a[i - 1] @ spikes.MOVES) * emit[i]
        a[i] /= a[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = (spikes.START @ (emit[i + 1] * b[i + 1]) * np.ones(4)) if start[i + 1] else spikes.MOVES @ (emit[i + 1] * b[i + 1])
        b[i] /= b[i].max()
    g = a * b
    return g / g.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 3001])
def test_posteriors_equal_brute_force(n):
    rng = np.random.default_rng(n)
    emit = rng.random((n, 4)) ** 4 + 1e-6
    start = rng.random(n) < 0.02
    start[0] = True
    assert np.allclose(spikes.posteriors(emit, start), brute(emit, start), atol=1e-9)


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def steady(link="a", n=60, first=0, jitter=True):
    return [(first + i, i, link, "d", 50.0 + (i * 7 % 11) * 0.3 * jitter, 100.0 - (i * 7 % 11) * 0.5 * jitter) for i in range(n)]


def found(df, **options):
    return {r.rec_id for r in spikes.flag_spikes(df, RULES, F.col("t"), **options).where("flagged").collect()}


def test_kinds_of_cases(spark):
    rows = steady()
    rows[5] = (5, 5, "a", "d", 130.0, 100.0)  # spike
    rows[9] = (9, 9, "a", "d", 0.0, 100.0)  # impossible
    rows[12] = (12, 12, "a", "d", 50.0, -3.0)
    for i in range(20, 30):
        rows[i] = (i, i, "a", "d", 51.7, rows[i][5])  # stuck in one field
    rows[40] = (40, 40, "a", "d", 80.0, 60.0)  # congestion's mirror: both within bounds, product normal
    rows[45] = (45, 45, "a", "d", 75.0, 110.0)  # product off
    assert found(table(spark, rows)) == {5, 9, 12, 45, *range(20, 30)}


def test_nine_equal_readings_are_normal(spark):
    rows = steady()
    for i in range(20, 29):
        rows[i] = (i, i, "a", "d", 51.7, rows[i][5])
    assert not found(table(spark, rows)) & set(range(20, 29))


def test_missing_readings_are_passed_over(spark):
    rows = steady()
    for i in range(20, 32):
        rows[i] = (i, i, "a", "d", {22: None, 25: float("nan")}.get(i, 51.7), rows[i][5])
    got = found(table(spark, rows))
    assert set(range(20, 32)) - {22, 25} == got & set(range(20, 32))


def test_odd_cases(spark):
    assert found(table(spark, [])) == set()
    assert found(table(spark, [(1, 1, None, "d", 500.0, 1.0), (2, 2, "", "d", -9.0, 1.0)])) == set()
    assert found(table(spark, [(1, None, "a", None, 500.0, None)])) == {1}
    twice = table(spark, steady() + [(99, 5, "a", "d", 500.0, 100.0)] * 2).withColumn("src", F.lit("clash")).withColumn("chunk", F.lit(1))
    assert found(twice) == {99}
    assert found(table(spark, [(1, 1, "a", "d", None, None)])) == set()


def test_cut_sources_give_the_same(spark, sf):
    train = spark.read.parquet(f"{sf}/trainset.parquet")
    # one field is missing for hundreds of successive records, more than a halo of records would hold
    train = train.withColumn("prcs_spd", F.when(F.floor(F.col("rec_id") / 1500) % 2 == 0, F.col("prcs_spd")))
    rules = missing.fit(train, "link_id", "detector_id", q.FIELDS)
    for strict in (True, False):
        whole, cut = ({r.rec_id: r for r in spikes.flag_spikes(train, rules, missing.minute_number(), strict=strict, **o).collect()} for o in ({}, {"hot_rows": 150, "halo": 100}))
        assert whole.keys() == cut.keys()
        for k, w in whole.items():
            assert (w.speed_state, w.travel_state, w.flagged, w.reason) == (cut[k].speed_state, cut[k].travel_state, cut[k].flagged, cut[k].reason)
            assert w.speed_doubt == pytest.approx(cut[k].speed_doubt, abs=1e-9) and w.travel_doubt == pytest.approx(cut[k].travel_doubt, abs=1e-9)


def test_states_assign_the_flags(spark, monkeypatch):
    rows = steady()
    for i in range(20, 30):
        rows[i] = (i, i, "a", "d", 51.7, rows[i][5])
    assert found(table(spark, rows)) == set(range(20, 30))
    spread = {r.rec_id: r for r in spikes.flag_spikes(table(spark, rows), RULES, F.col("t"), everything=True).collect()}
    assert len(spread) == 60 and spread[25].speed_state == "stuck" and spread[25].travel_state == "normal"
    # a chain that never gets stuck flags none of them
    never = spikes.MOVES.copy()
    never[:, 2] = 1e-30
    emit = np.full((12, 4), 0.5)
    emit[:, 2] = 4.9
    start = np.zeros(12, bool)
    start[0] = True
    assert spikes.posteriors(emit, start)[5].argmax() == 2
    monkeypatch.setattr(spikes, "MOVES", never)
    assert spikes.posteriors(emit, start)[5].argmax() != 2


def test_rules_find_stand_ins(spark, sf):
    train = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/trainset.parquet")
    rules = missing.fit(train, "link_id", "detector_id", q.FIELDS)
    assert "0000000000" in rules.sources
    assert dict(rules.values) == {"prcs_spd": (-1.0,), "prcs_trv_time": (9999.0,)}
    assert missing.fit(train.limit(0), "link_id", "detector_id", q.FIELDS).values == (("prcs_spd", ()), ("prcs_trv_time", ()))


def test_day_numbers(spark):
    rows = [("2024", "02", "29"), ("2023", "2", "29"), ("2024", "13", "1"), ("2024", "4", " 7 "), (None, "1", "1"), ("2024", "x", "1"), ("2024", "04", "31")]
    df = spark.createDataFrame(rows, "prcs_year string, prcs_mon string, prcs_day string")
    assert [r[0] for r in df.select(missing.day_number()).collect()] == [19782, None, None, 19820, None, None, None]
