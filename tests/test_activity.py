import datetime as dt
import random

import pytest

from ledgerlens.operators import activity

D0 = dt.date(2024, 1, 1)


def brute_force(rows, k, start, as_of):
    """Reference semantics by enumeration: (group, day) -> distinct consumers."""
    dates = [d for _, d, _ in rows if d is not None]
    mn = min(dates)
    out = {}
    c = start
    while c < as_of:
        if c > mn + dt.timedelta(days=k):
            per = {}
            for consumer, d, g in rows:
                if consumer is None or d is None:
                    continue
                if 0 <= (c - d).days <= k - 1:
                    per.setdefault(g, set()).add(consumer)
            for g, s in per.items():
                out[(g, c)] = len(s)
        c += dt.timedelta(days=1)
    return out


def edge_rows():
    d = lambda n: D0 + dt.timedelta(days=n)
    return [
        (1, d(0), "a"), (1, d(0), "a"),          # same user twice a day, first day
        (1, d(0), "b"),                          # user in two groups
        (2, d(7), "a"), (2, d(8), "a"),          # k-th day and the day after
        (3, d(29), "a"),                          # last day
        (4, d(3), None),                          # null group forms a group
        (5, None, "a"),                           # null date vanishes
        (None, d(4), "a"),                        # null consumer ignored
        (6, d(15), "b"), (6, d(17), "b"), (6, d(40), "b"),  # gaps, activity after as_of
    ]


@pytest.mark.parametrize("k", [1, 3, 7, 35])
@pytest.mark.parametrize("method", ["coverage", "expand"])
def test_rolling_matches_brute_force(spark, k, method):
    data = edge_rows()
    df = spark.createDataFrame(data, "consumer_id long, created_date date, grp string")
    start, as_of = D0 - dt.timedelta(days=3), D0 + dt.timedelta(days=31)
    got = activity.rolling_active_users(df, group_cols=["grp", "calendar_date"], window_days=k, kpi="x",
                                        start=start, as_of=as_of, method=method)
    assert got.columns == ["grp", "calendar_date", f"x_{k}"]
    got = {(r.grp, r.calendar_date): r[f"x_{k}"] for r in got.collect()}
    assert got == brute_force(data, k, start, as_of)


def test_rolling_random_coverage_equals_expand(spark):
    rnd = random.Random(5)
    data = [(rnd.randrange(40), D0 + dt.timedelta(days=rnd.randrange(90)), rnd.choice("xyz")) for _ in range(800)]
    df = spark.createDataFrame(data, "consumer_id long, created_date date, grp string")
    kw = dict(group_cols=["grp"], window_days=10, start=D0, as_of=D0 + dt.timedelta(days=95))
    a = {tuple(r) for r in activity.rolling_active_users(df, method="coverage", **kw).collect()}
    b = {tuple(r) for r in activity.rolling_active_users(df, method="expand", **kw).collect()}
    assert a == b
    assert a == {(g, c, n) for (g, c), n in brute_force(data, 10, D0, D0 + dt.timedelta(days=95)).items()}


def test_rolling_without_groups(spark):
    data = [(1, D0, None), (2, D0 + dt.timedelta(days=2), None)]
    df = spark.createDataFrame(data, "consumer_id long, created_date date, grp string")
    got = activity.rolling_active_users(df, window_days=3, kpi="wau", start=D0, as_of=D0 + dt.timedelta(days=10))
    assert got.columns == ["calendar_date", "wau_3"]
    assert {(r[0], r[1]) for r in got.collect()} == {(D0 + dt.timedelta(days=4), 1)}


def test_trailing_distinct(spark):
    ts = lambda n, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=h)
    df = spark.createDataFrame([(1, ts(0), "p"), (2, ts(0, 23), "p"), (3, ts(7), "p"), (4, ts(6), "q"),
                                (1, ts(-1, 23), "p")], "consumer_id long, created_at timestamp_ntz, g string")
    got = activity.trailing_distinct(df, ts_col="created_at", group_cols=["g"], days=7, as_of="2024-01-08")
    assert {(r.g, r.qtt) for r in got.collect()} == {("p", 2), ("q", 1)}


def test_rolling_with_known_min_date(spark):
    data = edge_rows()
    df = spark.createDataFrame(data, "consumer_id long, created_date date, grp string")
    kw = dict(group_cols=["grp"], window_days=7, start=D0, as_of=D0 + dt.timedelta(days=31))
    a = {tuple(r) for r in activity.rolling_active_users(df, **kw).collect()}
    b = {tuple(r) for r in activity.rolling_active_users(df, min_date=D0, **kw).collect()}
    assert a == b


def test_rolling_with_hot_group_and_consumer(spark):
    rnd = random.Random(9)
    data = [(rnd.randrange(50), D0 + dt.timedelta(days=rnd.randrange(40)), rnd.choice("bc")) for _ in range(600)]
    data += [(7, D0 + dt.timedelta(days=rnd.randrange(40)), "hot") for _ in range(300)]   # a third of all rows
    df = spark.createDataFrame(data, "consumer_id long, created_date date, grp string")
    kw = dict(group_cols=["grp"], window_days=5, start=D0, as_of=D0 + dt.timedelta(days=45))
    got = {(g, c): n for g, c, n in activity.rolling_active_users(df, **kw).collect()}
    assert got == brute_force(data, 5, D0, D0 + dt.timedelta(days=45))
