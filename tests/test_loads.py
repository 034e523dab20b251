import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlens.operators import activity
from ledgerlens.plans import jobs
from ledgerlens.sources import sinks
from ledgerlens.streaming import incremental, loads

SCHEMA = "d date, g string, v long"


def day(m, d, y=2024):
    return dt.date(y, m, d)


def target_in(tmp_dir, grain="day"):
    return loads.Target(f"loads_{uuid.uuid4().hex}", f"{tmp_dir}/{grain}", grain)


def content(spark, target):
    return rows(spark.table(target.table).select("d", "g", "v")) if spark.catalog.tableExists(target.table) else []


def run(spark, target, source, until, delta=5, floor=None):
    w = loads.plan_window(spark, target, delta, full_load_start="2024-01-01", floor=floor)
    loads.load_window(spark.createDataFrame(source, SCHEMA), target, "d", w, until, writers=2)
    return w


@pytest.mark.parametrize("grain", ["day", "month"])
def test_an_emptied_month_moves_the_window_back(spark, tmp_dir, grain):
    target = target_in(tmp_dir, grain)
    source = [(day(2, 20), "a", 1), (day(2, 27), "a", 2), (day(3, 1), "a", 3)]
    assert not run(spark, target, source, day(3, 1)).exists
    # March is gone in the source, and with it Feb 27
    w = run(spark, target, source[:1], day(3, 5))
    assert w.exists and w.max_date == day(3, 1)
    assert content(spark, target) == source[:1]
    w = run(spark, target, source[:1] + [(day(2, 22), "b", 9)], day(3, 6))
    assert w.max_date == day(2, 20) and w.cut == (day(2, 15) if grain == "day" else day(2, 1))
    assert content(spark, target) == source[:1] + [(day(2, 22), "b", 9)]
    # a load that empties the table, then one that fills it again from the start
    run(spark, target, [], day(3, 6), delta=400)
    assert content(spark, target) == [] and loads.partitions(spark, target) == set()
    assert not run(spark, target, source, day(3, 1)).exists
    assert content(spark, target) == source
    log = loads.journal(spark, target).orderBy("load").collect()
    assert [(r.load, r.newest_day, r.n_rows) for r in log] == [(1, day(3, 1), 3), (2, day(2, 20), 0 if grain == "day" else 1), (3, day(2, 22), 2), (4, None, 0), (5, day(3, 1), 3)]


@pytest.mark.parametrize("grain", ["day", "month"])
def test_random_loads_equal_their_ranges(spark, tmp_dir, grain):
    """After each load the days of its range are the source's, all others as they were."""
    rng, target, held = random.Random(grain), target_in(tmp_dir, grain), []
    for step in range(5):
        source = sorted({(day(1, 1) + dt.timedelta(days=rng.randrange(90)), rng.choice("ab"), step) for _ in range(rng.choice([0, 4, 60]))}, key=str)
        until = day(1, 1) + dt.timedelta(days=rng.randrange(60, 95))
        w = run(spark, target, source, until, delta=rng.choice([3, 40]))
        low, high = (target.first_of(w.cut), target.last_of(until)) if w.exists else (dt.date.min, dt.date.max)
        cap = until if not w.exists else high
        held = [r for r in held if not low <= r[0] <= high] + [r for r in source if max(low, w.cut) <= r[0] <= cap]
        assert content(spark, target) == sorted(held, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_readers_between_the_steps_see_whole_old_or_new_days(spark, tmp_dir, monkeypatch):
    target = target_in(tmp_dir)
    old = [(day(3, d), "old", d) for d in range(1, 11)] * 3
    new = [(day(3, d), "new", d) for d in (6, 7, 9, 12)] * 5
    run(spark, target, old, day(3, 10))
    seen = []
    whole = {"old": {d: 3 for d in range(1, 11)}, "new": {6: 5, 7: 5, 9: 5, 12: 5}}
    real = loads.swap_statements

    def watched(*args):
        for statement in real(*args):
            found = {}
            for d, g, v in content(spark, target):
                found.setdefault((d.day, g), []).append(v)
            assert all(len(v) == whole[g][d] for (d, g), v in found.items())
            assert len({d for d, _ in found}) == len(found)                    # never both
            assert {d for d, _ in found} >= set(range(1, 11))                  # nothing is missing while others move
            seen.append(len(found))
            yield statement

    monkeypatch.setattr(loads, "swap_statements", watched)
    reader = spark.table(target.table).where("g = 'old'")
    assert reader.count() == 30
    run(spark, target, new, day(3, 12))
    assert len(seen) == 5                                                        # one add, three moves, one drop
    assert content(spark, target) == sorted([r for r in old if r[0] < day(3, 5)] + new, key=lambda r: tuple((False, str(x)) for x in r))


def test_a_load_lost_before_its_journal_row_is_repeated(spark, tmp_dir, monkeypatch):
    target = target_in(tmp_dir)
    run(spark, target, [(day(3, d), "a", 1) for d in range(1, 11)], day(3, 10))
    source = [(day(3, d), "a", 2) for d in range(1, 9)]
    statements = loads.swap_statements

    def broken(*args):
        yield from statements(*args)[:2]
        raise RuntimeError("executor of the driver lost")

    monkeypatch.setattr(loads, "swap_statements", broken)
    with pytest.raises(RuntimeError):
        run(spark, target, source, day(3, 12))
    monkeypatch.undo()
    w = run(spark, target, source, day(3, 12))
    assert w.max_date == day(3, 10) and loads.journal(spark, target).count() == 2
    assert content(spark, target) == [(day(3, d), "a", 1 if d < 5 else 2) for d in range(1, 9)]


def test_old_folders_are_named_and_kept(spark, tmp_dir):
    target = target_in(tmp_dir)
    run(spark, target, [(day(3, 1), "a", 1), (day(3, 2), "a", 1)], day(3, 2))
    run(spark, target, [(day(3, 2), "a", 2)], day(3, 2), delta=0)
    assert loads.unreferenced_folders(spark, target) == []                      # March 1 is in the first one
    run(spark, target, [(day(3, 1), "a", 3), (day(3, 2), "a", 3)], day(3, 2), delta=10)
    free = loads.unreferenced_folders(spark, target)
    assert len(free) == 2 and spark.read.parquet(free[0]).count() == 2


def test_nulls_other_columns_and_refusals(spark, tmp_dir):
    target = target_in(tmp_dir)
    source = spark.createDataFrame([(day(3, 1), "a", 1), (None, "a", 2)], SCHEMA).withColumn("year_partition", F.lit("x"))
    loads.load_range(source, target, "d", None)
    assert content(spark, target) == [(day(3, 1), "a", 1)]
    with pytest.raises(ValueError):
        loads.load_range(source.withColumn("more", F.lit(1)), target, "d", None)
    with pytest.raises(ValueError):
        loads.Target("t", tmp_dir, fmt="delta")
    with pytest.raises(ValueError):
        loads.Target("t", tmp_dir, grain="year")
    with pytest.raises(ValueError):
        incremental.replace_days(source, tmp_dir, "d", day(1, 1), fmt="delta")
    with pytest.raises(ValueError):
        incremental.plan_window(spark, tmp_dir, None, 5, fmt="delta")
    assert loads.plan_window(spark, target, 100, floor="2024-02-10").start == day(2, 10)
    assert loads.unreferenced_folders(spark, target_in(tmp_dir, "month")) == []


@pytest.mark.parametrize("swapped", [False, True])
def test_rolling_metric_after_an_emptied_month_equals_a_full_load(spark, tmp_dir, swapped):
    """Three runs: a table up to March 1, a source that lost March, one that lost the days before as well."""
    schema = "consumer_id long, created_date date, g string"
    target = target_in(tmp_dir) if swapped else f"{tmp_dir}/mat"
    kw = dict(group_cols=["g"], window_days=3, kpi="act", delta_days=5, full_load_start="2024-01-01", writers=2)
    source = [(c, day(1, 5) + dt.timedelta(days=c), "p") for c in range(57)]                # up to March 1
    for keep, as_of in ((day(3, 2), "2024-03-02"), (day(2, 26), "2024-03-02"), (day(2, 10), "2024-03-02"), (day(2, 10), "2024-03-02"), (day(2, 10), "2024-03-02")):
        part = [r for r in source if r[1] < keep]
        jobs.rolling_metric_job(spark, spark.createDataFrame(part, schema), target, as_of=as_of, **kw)
    out = spark.table(target.table) if swapped else spark.read.parquet(target)
    got = {(r.calendar_date, r.act_3) for r in out.collect()}
    full = activity.rolling_active_users(spark.createDataFrame(part, schema), group_cols=["g"], window_days=3, kpi="act", start="2024-01-01", as_of=as_of)
    want = {(r.calendar_date, r.act_3) for r in full.collect()}
    # each run looks five days back from the newest day that the one before left
    assert got == want and max(d for d, _ in want) == day(2, 11)


def test_newest_folder_walks_back_over_emptied_ones(spark, tmp_dir):
    frame = spark.createDataFrame([(day(2, 20), 1), (day(2, 27), 1), (day(3, 1), 1)], "d date, v long")
    sinks.write_partitioned(sinks.with_date_partitions(frame, "d"), f"{tmp_dir}/t")
    sinks.drop_days(spark, f"{tmp_dir}/t", [day(3, 1)])
    assert sinks.newest_partition(spark, f"{tmp_dir}/t") == ("2024", "02", "27")
    fs, path = sinks._folder(spark, f"{tmp_dir}/t")
    of = spark._jvm.org.apache.hadoop.fs.Path
    assert not fs.exists(of(f"{tmp_dir}/t/year_partition=2024/month_partition=03"))
    fs.mkdirs(of(f"{tmp_dir}/t/year_partition=2025/month_partition=01/day_partition=09"))     # as another tool may leave it
    assert sinks.newest_partition(spark, f"{tmp_dir}/t") == ("2024", "02", "27")
    sinks.drop_days(spark, f"{tmp_dir}/t", [day(2, 20), day(2, 27)])
    assert sinks.newest_partition(spark, f"{tmp_dir}/t") is None and not fs.exists(of(f"{tmp_dir}/t/year_partition=2024"))


def test_a_folder_target_that_lost_its_last_month(spark, tmp_dir):
    path, schema = f"{tmp_dir}/t", "d date, v long"
    source = [(day(2, 20), 1), (day(2, 27), 1), (day(3, 1), 1)]
    for part in (source, source[:1], source[:1], source[:1]):
        w = incremental.plan_window(spark, path, None, 5, 0, full_load_start="2024-01-01")
        incremental.incremental_write(spark.createDataFrame(part, schema), path, "d", w)
    assert rows(spark.read.parquet(path), "d", "v") == source[:1]
