import datetime as dt
import random

from barloom.operators.tablediff import diff_tables

SCHEMA = "symbol string, date date, fetched_at int, close double, volume double, side string, segment int"


def diff(spark, a, b):
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    out = diff_tables(left, right, entity="symbol", order="date", version="fetched_at", fields=["close", "volume"])
    return sorted((r.entity, r.day, r.issue) for r in out.collect())


def test_against_brute_force(spark):
    rnd = random.Random(5)
    a, b, want = [], [], []
    for s in ("x", "y"):
        for k in range(300):
            day = dt.date(2023, 1, 1) + dt.timedelta(k)
            row = (s, day, 1, rnd.random() * 100, float(rnd.randrange(1000)), "q", 1)
            a.append(row)
            u = rnd.random()
            if u < 0.03:
                want.append((s, day, "missing_in_right"))
                continue
            noise = row[3] + rnd.uniform(-4e-4, 4e-4)
            if u < 0.06:
                b.append((s, day, 1, noise + 1, row[4], "q", 1))
                want.append((s, day, "close"))
            elif u < 0.08:
                b.append((s, day, 1, noise, float("nan"), "q", 1))
                want.append((s, day, "volume"))
            else:
                b.append((s, day, 1, noise, row[4], "q", 1))
            if u > 0.95:  # an older, wrong version, and a repeated row
                b += [(s, day, 0, -1.0, -1.0, "q", 1), b[-1]]
    extra = ("z", dt.date(2024, 5, 5), 1, 1.0, 1.0, "q", 1)
    assert diff(spark, a, [*b, extra]) == sorted([*want, ("z", extra[1], "missing_in_left")])


def test_null_is_nan_and_null_keys_and_empty(spark):
    day = dt.date(2023, 1, 1)
    a = [("x", day, 1, None, 1.0, "q", 1), (None, day, 1, 1.0, 1.0, "q", 1), ("x", None, 1, 1.0, 1.0, "q", 1)]
    assert diff(spark, a, [("x", day, 1, float("nan"), 1.0, "q", 1)]) == []
    assert diff(spark, a, []) == [("x", day, "missing_in_right")]
    assert diff(spark, [], a) == [("x", day, "missing_in_left")]
    assert diff(spark, [], []) == []
