import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlens.streaming.dedupe_state import DedupeState

SCHEMA = "movement long, status string, at timestamp_ntz, id string, v int, bucket_ string"


def events(seed, days, n=400, keys=120):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(keys)]), rng.choice(["A", "B", None]), dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.choice(days), hours=rng.randrange(24)),
             rng.choice([None, f"{rng.randrange(10 ** 6):06d}"]) if rng.random() < 0.03 else f"{rng.randrange(10 ** 6):06d}", i, "x") for i in range(n)]


def state_at(path, **kw):
    return DedupeState(path, ("movement", "status"), ("id", "v"), "at", **{"buckets": 8, **kw})


def whole(spark, events_):
    from ledgerlens.operators.rank import top_per_group
    return rows(top_per_group(spark.createDataFrame(events_, SCHEMA), ["movement", "status"], ["id", "v"]))


@pytest.mark.parametrize("seed,space", [(1, 1 << 18), (2, 64)])
def test_many_windows_equal_one_dedupe(spark, tmp_dir, seed, space):
    """Late duplicates, repeated windows, nulls in keys and orders; a filter of 64 bits errs all the time."""
    state, kept, all_events = state_at(f"{tmp_dir}/s", space=space), None, []
    for step, days in enumerate((range(0, 10), range(10, 20), range(10, 20), range(5, 12), range(0, 30))):
        window = events(seed * 100 + (1 if step == 2 else step), list(days), n=0 if step == 3 and seed == 2 else 150)
        all_events += window
        survivors, displaced = state.run(spark.createDataFrame(window, SCHEMA))
        assert survivors.columns == ["movement", "status", "at", "id", "v", "bucket_"]
        moved = {(r.movement, r.status, r.id, r.v): r.day for r in displaced.collect()}
        if kept is not None:
            known = {(r.movement, r.status, r.id, r.v): r["at"].date() for r in kept.collect()}
            assert all(known[k] == d for k, d in moved.items())
        kept = survivors if kept is None else state.without(kept, displaced).unionByName(survivors)
        kept = kept.dropDuplicates().checkpoint()
        assert rows(kept) == whole(spark, sorted(set(all_events), key=str))
    held = state.seen(spark)
    assert held.count() == kept.count()


def test_a_repeated_window_adds_nothing(spark, tmp_dir):
    state, window = state_at(f"{tmp_dir}/s"), events(5, list(range(10)))
    one, _ = state.run(spark.createDataFrame(window, SCHEMA))
    before = spark.read.parquet(f"{tmp_dir}/s/seen").count()
    two, displaced = state.run(spark.createDataFrame(window, SCHEMA))
    assert rows(one) == rows(two) and displaced.count() == 0 and spark.read.parquet(f"{tmp_dir}/s/seen").count() == before


def test_only_buckets_with_a_key_seen_before_are_read(spark, tmp_dir, monkeypatch):
    state = DedupeState(f"{tmp_dir}/s", ("movement",), ("id",), "at", bucket_of=F.floor(F.col("movement") / 100))
    window = lambda ids: spark.createDataFrame([(i, "A", dt.datetime(2024, 1, 1), "5", 0, "") for i in ids], SCHEMA)
    state.run(window(range(0, 1000)))
    read = []
    seen = DedupeState.seen
    monkeypatch.setattr(DedupeState, "seen", lambda self, s, buckets=None: (read.append(buckets), seen(self, s, buckets))[1])
    late = window([*range(1000, 1200), 250]).withColumn("id", F.when(F.col("movement") == 250, "1").otherwise("7"))
    survivors, displaced = state.run(late)
    assert [b for b in read if b is not None] == [[2]]                        # bucket 2 of twelve
    assert survivors.count() == 201 and [(r.movement, r.id, r.day) for r in displaced.collect()] == [(250, "5", dt.date(2024, 1, 1))]
    scan = seen(state, spark, [2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(bucket" in scan or "PartitionFilters: [isnotnull(bucket" in scan


def test_empty_windows_and_a_lost_run(spark, tmp_dir):
    state = state_at(f"{tmp_dir}/s")
    none = spark.createDataFrame([], SCHEMA)
    survivors, displaced = state.run(none)
    assert survivors.count() == displaced.count() == 0
    window = events(8, list(range(5)))
    # a run that was lost after it wrote the filters and before it wrote the keys
    frame = spark.createDataFrame(window, SCHEMA)
    places = frame.select(state.bucket().alias("bucket"), F.explode(state.positions()).alias("_place")).distinct()
    places.groupBy("bucket", F.expr("bitmap_bucket_number(_place)").alias("block")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_place))").alias("bits")).write.mode("append").partitionBy("bucket").parquet(f"{tmp_dir}/s/filters")
    survivors, displaced = state.run(frame)
    assert rows(survivors) == whole(spark, window) and displaced.count() == 0


def test_a_run_exchanges_no_row_of_a_first_window_and_no_bit_position(spark, tmp_dir):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = state_at(f"{tmp_dir}/s")
        survivors, displaced = state.run(spark.createDataFrame(events(1, [1, 2]), SCHEMA))
        assert "Exchange" not in survivors._jdf.queryExecution().executedPlan().toString() and displaced.count() == 0
        keyed = spark.createDataFrame(events(2, [3]), SCHEMA).withColumn("bucket", state.bucket()).dropDuplicates(["movement", "status"]).checkpoint()
        plan = state.suspects(keyed)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        second, _ = state.run(spark.createDataFrame(events(3, [4]), SCHEMA))
        third, displaced = state.run(spark.createDataFrame(events(3, [4]), SCHEMA))
        for left, exchanges in ((second, 2), (state.without(second, displaced), 3)):          # the survivors are exchanged once
            plan = left._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == exchanges, plan
        old_rows = state.seen(spark, [0, 1, 2, 3])
        joined = spark.createDataFrame(events(4, [5]), SCHEMA).select(state.bucket().alias("bucket"), F.struct("movement", "status").alias("_key")).join(old_rows, ["bucket", "_key"], "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2, plan                 # one a side
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
