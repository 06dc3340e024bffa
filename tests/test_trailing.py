import datetime as dt
import random

from pyspark.sql import functions as F

from barloom.operators.trailing import entity_calendar, trailing_totals

D = dt.date


def run(spark, cal, ev, **kw):
    c = spark.createDataFrame(cal, "symbol string, date date, entity string, bucket int")
    e = spark.createDataFrame(ev, "symbol string, effective_date date, v double, day string")
    return trailing_totals(c, e, measures={"n": F.lit(1), "v": F.col("v")}, periods={"short": 5, "long": 30}, means=("v",), **kw)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    start = D(2023, 1, 1)
    ev = [(rnd.choice("aaab"), start + dt.timedelta(rnd.randrange(120)), rnd.choice([1.0, 2.0, None]), "x") for _ in range(400)]
    cal = [(s, start + dt.timedelta(k), "clash", 1) for s in "abc" for k in range(-3, 160, 3)]
    got = {(r.entity, r.day): r for r in run(spark, cal, ev).collect()}
    assert len(got) == len(cal)
    for s, day, _, _ in cal:
        for name, days in (("short", 5), ("long", 30)):
            inside = [e for e in ev if e[0] == s and day - dt.timedelta(days) <= e[1] <= day]
            vs = [e[2] for e in inside if e[2] is not None]
            r = got[s, day]
            assert r[f"n_{name}"] == len(inside)
            assert r[f"v_{name}"] == sum(vs)
            assert r[f"v_mean_{name}"] == (sum(vs) / len(vs) if vs else None)


def test_nulls_repeats_and_empty(spark):
    day = D(2023, 3, 1)
    cal = [("a", day, "x", 0), ("a", day, "x", 0), (None, day, "x", 0), ("a", None, "x", 0)]
    rows = run(spark, cal, [("a", None, 1.0, "x"), (None, day, 1.0, "x")]).collect()
    assert [(r.entity, r.n_long, r.v_mean_long) for r in rows] == [("a", 0, None)]
    assert run(spark, [], []).collect() == []


def test_calendar_has_the_quiet_days(spark):
    e = spark.createDataFrame([("a", D(2023, 1, 1)), ("a", D(2023, 1, 4)), ("b", None)], "s string, d date")
    assert sorted(r.day.day for r in entity_calendar(e, "s", "d").collect()) == [1, 2, 3, 4]
