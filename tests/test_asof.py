import datetime as dt
import random

from barloom.operators.asof import attributes_as_of

BASE = dt.datetime(2023, 1, 1)


def run(spark, events, versions):
    e = spark.createDataFrame(events, "row_id long, symbol string, published_at timestamp_ntz, effective_date date, day int, block int")
    v = spark.createDataFrame(versions, "row_id long, symbol string, date date, fetched_at timestamp_ntz, w double, entity string")
    out = attributes_as_of(e, v, event_id="row_id", event_entity="symbol", event_time="published_at", event_day="effective_date", version_id="row_id", version_entity="symbol", version_day="date", version_time="fetched_at", attributes=["w"])
    return sorted((r.event_id, r.version_id, r.w) for r in out.collect())


def want(events, versions):
    out = []
    for i, s, p, d, *_ in events:
        ok = [v for v in versions if None not in (s, p, d) and None not in v[:4] and v[1] == s and v[2] <= d and v[3] <= p]
        if ok:
            best = min(ok, key=lambda v: (-v[2].toordinal(), -(v[3] - BASE).total_seconds(), v[0]))
            out.append((i, best[0], best[4]))
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(9)
    moment = lambda k: BASE + dt.timedelta(hours=rnd.randrange(24 * k))
    versions = []
    for i in range(500):
        day = moment(200)
        late = rnd.choice([0, 0, 0, -40, 3, 90])
        versions.append((i, rnd.choice("aaab"), day.date(), day + dt.timedelta(days=late, hours=rnd.randrange(4)), rnd.choice([None, 1.5, 2.5]), "clash"))
    versions += [(1000 + i, *v[1:]) for i, v in enumerate(versions[:60])]
    events = []
    for i in range(600):
        t = moment(260)
        events.append((i, rnd.choice("aaabc"), t, (t + dt.timedelta(days=rnd.choice([0, 0, 1, -30, -100, 20]))).date(), 1, 2))
    got = run(spark, events, versions)
    assert got == want(events, versions) and len(got) > 300


def test_ties_nulls_and_empty(spark):
    d = BASE.date()
    versions = [(2, "a", d, BASE, 1.0, "x"), (1, "a", d, BASE, 2.0, "x"), (3, "a", None, BASE, 1.0, "x"), (4, None, d, BASE, 1.0, "x"), (5, "a", d, None, 1.0, "x")]
    events = [(1, "a", BASE, d, 0, 0), (2, "a", None, d, 0, 0), (3, "a", BASE, None, 0, 0), (4, None, BASE, d, 0, 0), (5, "a", BASE - dt.timedelta(seconds=1), d, 0, 0)]
    assert run(spark, events, versions) == [(1, 1, 2.0)]
    assert run(spark, [], versions) == [] and run(spark, events, []) == []
