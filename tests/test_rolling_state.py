import datetime as dt
import random

import pytest

from conftest import rows
from ledgerlens.operators import activity
from ledgerlens.streaming.rolling_state import RollingState

SCHEMA = "consumer_id long, created_date date, g string, other int"


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def full(spark, rows_, k):
    return rows(activity.rolling_active_users(spark.createDataFrame(rows_, SCHEMA), group_cols=["g"], window_days=k, kpi="mau", start="2024-01-01", as_of="2024-06-01"))


@pytest.mark.parametrize("seed,k", [(1, 7), (2, 1), (3, 35)])
def test_runs_equal_a_full_recompute(spark, tmp_dir, seed, k):
    """Late rows, gaps, repeated rows, nulls, empty runs; one consumer with a third of all rows."""
    rng, state, all_rows = random.Random(seed), RollingState(f"{tmp_dir}/s", ("g",), k, late_days=30), []
    for step in range(6):
        low = max(0, 20 * step - 25)
        n = 0 if step == 3 else 120
        part = [(rng.choice([1, None, *range(12)]) if i % 3 else 1, rng.choice([None, day(rng.randrange(low, 20 * step + 5))]) if i % 20 == 0 else
                 day(rng.randrange(low, 20 * step + 5)), rng.choice(["a", "b", None]), i) for i in range(n)]
        part += part[:10]
        rejected = state.run(spark.createDataFrame(part, SCHEMA))
        assert rejected.count() == 0
        all_rows += part
        assert rows(state.metric(spark, "2024-01-01", "2024-06-01")) == full(spark, all_rows, k)
    held = spark.read.parquet(f"{tmp_dir}/s/state/run=6")
    assert min(min(r["_days"]) for r in held.collect()) >= max(r[1] for r in all_rows if r[1]) - dt.timedelta(days=30 + k)


def test_rows_that_come_too_late_are_returned(spark, tmp_dir):
    state = RollingState(f"{tmp_dir}/s", ("g",), 7, late_days=10)
    first = [(1, day(50), "a", 0), (2, day(45), "a", 0)]
    state.run(spark.createDataFrame(first, SCHEMA))
    late = [(3, day(39), "a", 1), (3, day(40), "a", 2), (None, None, None, 3)]
    assert rows(state.run(spark.createDataFrame(late, SCHEMA)), "other") == [(1,)]
    assert rows(state.metric(spark, "2024-01-01", "2024-06-01")) == full(spark, [*first, late[1]], 7)


def test_a_lost_run_is_repeated_under_its_number(spark, tmp_dir):
    state = RollingState(f"{tmp_dir}/s", ("g",), 7)
    one = spark.createDataFrame([(1, day(1), "a", 0), (1, day(20), "a", 0)], SCHEMA)
    state.run(one)
    # a run that wrote its deltas and then was lost
    spark.createDataFrame([("a", day(2), 100)], "g string, day date, delta long").write.parquet(f"{tmp_dir}/s/deltas/run=2")
    assert state.runs(spark) == 1
    two = [(2, day(21), "a", 0)]
    state.run(spark.createDataFrame(two, SCHEMA))
    assert state.runs(spark) == 2
    assert rows(state.metric(spark, "2024-01-01", "2024-06-01")) == full(spark, [(1, day(1), "a", 0), (1, day(20), "a", 0), *two], 7)
