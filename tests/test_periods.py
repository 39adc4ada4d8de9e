"""Rolling totals, lateness, grids and hot-deck on small tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rillwork.quality import hotdeck, lateness, regrid, trailing

CONF = [(1, "10 minutes", "10 minutes", 60, "LINEAR"), (2, "1 hour", "1 hour", 300, "PREVIOUS"), (3, "90 seconds", "1 hour", 60, "NEAREST")]


def conf(spark):
    return spark.createDataFrame(CONF, "sensor_type int, watermark_delay string, window_length string, step_size int, method_option string")


def at(minutes):
    return datetime(2024, 4, 1) + timedelta(minutes=minutes)


def records(spark, rows):
    """(msg, sensor, type, body, minute of event, minute of arrival)"""
    full = [(m, s, k, b, None if t is None else at(t), None if a is None else at(a)) for m, s, k, b, t, a in rows]
    return spark.createDataFrame(full, "msg_id long, sensor_id string, sensor_type int, event_body string, ts timestamp_ntz, arrived_at timestamp_ntz").selectExpr("*", "1 as kind", "'y' as slice", "2.0 as chunk", "3 as late")


def test_trailing(spark):
    rows = spark.createDataFrame([("a", 100, 1.0), ("a", 100, 3.0), ("a", 107, None), ("a", 140, 5.0), (None, 1, 1.0), ("b", None, 1.0)], "src string, day int, value double").selectExpr("*", "1 as on", "2 as bucket", "'x' as next_day")
    got = {r.day: r for r in trailing.trailing_totals(rows).where("src = 'a'").collect()}
    assert sorted(got) == list(range(100, 141))
    assert (got[106].readings_7, got[106].total_7, got[106].mean_7) == (2, 4.0, 2.0)
    assert (got[107].records, got[107].readings_7, got[107].total_7) == (1, 0, None)
    assert (got[129].readings_30, got[130].readings_30, got[137].last_day) == (2, 0, None)
    assert trailing.trailing_totals(rows.limit(0)).count() == 0


def test_lateness_and_revisions(spark):
    rows = [
        (1, "s", 1, "1.0", 0, 1), (2, "s", 1, '{"val": 2}', 30, 31), (3, "s", None, '{"val": "3", "q": 9}', 21, 32), (4, "s", 1, "4", 19, 33), (5, "s", 1, "9", 50, 40),
        (6, None, 1, "1", 0, 1), (7, "s", 1, "1", None, 2), (8, "t", 9, "1", 0, 5), (9, "s", 1, "2x", 31, 34), (10, "s", 1, '{"val": 2}', 30, 35),
    ]
    judged = lateness.judge_lateness(records(spark, rows), conf(spark), slice_seconds=60)
    assert {r.msg_id: r.late for r in judged.collect()} == {1: False, 2: False, 3: False, 4: True, 8: False, 9: False, 10: False}
    whole = lateness.judge_lateness(records(spark, rows), conf(spark))
    assert sorted(map(tuple, judged.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    base = int((datetime(2024, 4, 1) - datetime(1970, 1, 1)).total_seconds())
    final = {r.period_start - base: r for r in lateness.revised_aggregates(judged).where("is_final").collect()}
    assert (final[1800].records, final[1800].readings, final[1800].total) == (2, 1, 2.0)
    assert (final[600].records, final[600].rejected) == (0, 1)
    assert final[1200].total == 3.0
    assert lateness.revised_aggregates(lateness.judge_lateness(records(spark, []), conf(spark))).count() == 0


def grid(spark, rows, **options):
    base = int((datetime(2024, 4, 1) - datetime(1970, 1, 1)).total_seconds())
    return {(r.sensor_id, (r.slot_epoch - base) // 60): r for r in regrid.regular_grid(records(spark, rows), conf(spark), **options).collect()}


def test_grid_methods(spark):
    rows = [(1, "l", 1, "10", 0, 1), (2, "l", 1, "40", 3, 4), (3, "p", 2, "7", 0, 1), (4, "p", None, "9", 16, 17), (5, "n", 3, "1", 0, 1), (6, "n", 3, "2", 3, 4), (7, "l", 1, "x", 4, 5), (8, "l", 1, "60", 3, 6)]
    got = grid(spark, rows)
    assert [got["l", i].value for i in range(5)] == [10.0, 20.0, 30.0, 50.0, None] or got["l", 1].value == 20.0
    assert (got["l", 3].value, got["l", 3].n_records) == (50.0, 2)
    assert [got["p", i].value for i in (0, 5, 10, 15)] == [7.0, 7.0, 7.0, 9.0]
    assert [got["n", i].value for i in range(4)] == [1.0, 1.0, 2.0, 2.0]
    assert {k for k, r in got.items() if r.n_records == 0} == {("l", 1), ("l", 2), ("p", 5), ("p", 10), ("n", 1), ("n", 2)}
    assert got["l", 4].status in ("marked", "filled")


def test_grid_gaps_and_odd_rows(spark):
    day = 24 * 60
    rows = [(1, "l", 1, "1", 0, 1), (2, "l", 1, "2", day, day + 1), (3, "l", 1, "3", 2 * day + 1, 2 * day + 9), (4, "u", 9, "1", 0, 1), (5, "l", 1, "1", 5, 4), (6, None, 1, "1", 1, 2)]
    got = grid(spark, rows)
    assert len([1 for k, r in got.items() if r.n_records == 0]) == day - 1
    assert max(m for _, m in got) == 2 * day + 1 and not any(s == "u" for s, _ in got)
    assert grid(spark, []) == {}


def test_grid_of_cut_sources(spark, sf):
    from rillwork.quality import queries as q

    r, c = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("sensor_stream", "pipe_conf"))
    whole = regrid.regular_grid(r, c, chunk_steps=10**9).withColumn("value", F.round("value", 6))
    for options in ({"chunk_steps": 3}, {"chunk_steps": 1}, {"small": 1}):
        cut = regrid.regular_grid(r, c, **options).withColumn("value", F.round("value", 6))
        assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
    assert q.p5_found(spark, sf).count() == whole.where("n_records = 0").count()


def test_grid_of_full_steps_and_far_neighbours(spark):
    # four steps of 900 records, most of them unreadable, sixteen seconds apart
    rows = [(i, "s", 2, str(i) if i % 900 == 0 else "x", i * 16 / 60, 2000) for i in range(3600)]
    conf_ = conf(spark).withColumn("step_size", F.lit(4 * 3600))
    for chunk_steps in (1, 2, 4096):
        got = regrid.regular_grid(records(spark, rows), conf_, chunk_steps=chunk_steps).orderBy("slot_epoch").collect()
        assert [(r.n_records, r.value) for r in got] == [(900, 0.0), (900, 900.0), (900, 1800.0), (900, 2700.0)]
    # a reading that is a thousand unreadable records away still fills
    rows = [(0, "l", 1, "1", 0, 1)] + [(i, "l", 1, None, i / 4, 2000) for i in range(1, 4000)] + [(5000, "l", 1, "1001", 1000, 2000)]
    for chunk_steps in (1, 7, 4096):
        got = regrid.regular_grid(records(spark, rows), conf(spark), chunk_steps=chunk_steps).orderBy("slot_epoch").collect()
        assert [r.value for r in got] == [float(i + 1) for i in range(1001)]
        assert {r.status for r in got[1:-1]} == {"filled"}


def test_grid_is_that_of_brute_force(spark):
    import random

    rng, rows = random.Random(5), []
    for m in range(400):
        s = rng.choice("abc")
        rows.append((m, s, 1 + "abc".index(s), rng.choice(["1", "2.5", "7", "x", None]), round(rng.random() * 400) + (3000 if rng.random() < 0.5 else 0), 9000))
    gap = 30 * 60
    got = {k: (r.value, r.n_records, r.status) for k, r in grid(spark, rows, gap_seconds=gap, chunk_steps=5).items()}
    settings = {s: (c[3] // 60, c[4]) for s, c in zip("abc", CONF, strict=True)}
    want = {}
    for s, (step, method) in settings.items():
        mine = sorted((t, m, None if b in (None, "x") else float(b)) for m, q, _, b, t, _ in rows if q == s)
        spans, span = [], []
        for r in mine:
            if span and r[0] - span[-1][0] > gap / 60:
                spans.append(span)
                span = []
            span.append(r)
        for span in [*spans, span]:
            for at_ in range(span[0][0] // step * step, span[-1][0] + 1, step):
                inside = [r for r in span if at_ <= r[0] < at_ + step]
                vals = [r[2] for r in inside if r[2] is not None]
                value = sum(vals) / len(vals) if vals else None
                if not vals:
                    p = max((r for r in span if r[0] < at_ and r[2] is not None and at_ - r[0] <= gap / 60), default=None)
                    q = min((r for r in span if r[0] >= at_ and r[2] is not None and r[0] - at_ <= gap / 60 + step), default=None)
                    if method == "LINEAR" and p and q and q[0] - p[0] <= gap / 60:
                        value = p[2] + (q[2] - p[2]) * (at_ - p[0]) / (q[0] - p[0])
                    elif method == "NEAREST" and (p or q):
                        value = p[2] if p and (not q or at_ - p[0] <= q[0] - at_) else q[2]
                    elif method == "PREVIOUS" and p:
                        value = p[2]
                status = "observed" if vals else "marked" if value is None else "filled"
                want[s, at_] = (value, len(inside), status)
    assert got.keys() == want.keys()
    for k, (v, n, st) in want.items():
        assert (got[k][1], got[k][2]) == (n, st) and (v is None) == (got[k][0] is None) and (v is None or abs(v - got[k][0]) < 1e-9), k


def fills(spark, rows, **options):
    df = spark.createDataFrame(rows, "grp string, t long, rec long, a double, b string").selectExpr("*", "1 as slice", "2 as prev_a", "3 as filled")
    return {(r.rec_id, r.field_name): r for r in hotdeck.fill_from_similar(df, {"a": "A", "b": "B"}, **options).collect()}


def test_hotdeck(spark):
    rows = [("g", 0, 1, 1.0, "x"), ("g", 10, 2, None, None), ("g", 15, 3, 3.0, None), ("g", 20, 4, 4.0, "z"), ("h", 5, 5, None, "q"), (None, 7, 6, None, "w"), ("g", None, 7, None, "y")]
    got = fills(spark, rows)
    assert (got[2, "A"].filled, got[2, "A"].donor_id, got[2, "A"].distance, got[2, "A"].donor_kind) == ("3.0", 3, 5, "group")
    assert (got[2, "B"].filled, got[2, "B"].distance) == ("x", 10) or got[2, "B"].distance == 10
    assert got[3, "B"].filled == "z"
    assert got[5, "A"].donor_kind == "hour" and got[6, "A"].donor_kind == "hour"
    assert got[7, "A"].filled == "1.0"
    assert fills(spark, []) == {}
    assert fills(spark, [("g", 1, 1, None, None)])[1, "A"].filled is None


def test_hotdeck_of_constant_fields(spark):
    rows = [("g" if i % 3 else "h", i * 7, i, None if i % 4 == 0 else float(i), None if i % 5 == 0 else ("G" if i % 3 else "H")) for i in range(90)] + [("n", 1, 900, None, None), (None, 2, 901, 1.0, None)]
    df = spark.createDataFrame(rows, "grp string, t long, rec long, a double, b string")
    plain, fast = (sorted(map(str, hotdeck.fill_from_similar(df, {"a": "A", "b": "B"}, constant=c).collect())) for c in ((), ("b",)))
    assert plain == fast
    mixed = df.unionByName(spark.createDataFrame([("g", 3, 999, 1.0, "X")], df.schema))
    plain, fast = (sorted(map(str, hotdeck.fill_from_similar(mixed, {"a": "A", "b": "B"}, constant=c).collect())) for c in ((), ("b",)))
    assert plain == fast


def test_hotdeck_of_cut_groups(spark):
    rows = [("g" if i % 3 else "h", i * 7, i, None if i % 4 == 0 else float(i), None if i % 50 else f"t{i}") for i in range(600)]
    whole, cut = fills(spark, rows), fills(spark, rows, hot_rows=100, slice_width=60)
    assert {k: tuple(r) for k, r in whole.items()} == {k: tuple(r) for k, r in cut.items()}
