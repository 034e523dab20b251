import datetime as dt
import os

from pyspark.sql import functions as F

from ledgerlens.streaming import incremental as I


def frame(spark, days, value):
    return spark.createDataFrame([(dt.date(2024, 9, 28) + dt.timedelta(days=i), value) for i in range(days)],
                                 "d date, v long")


def test_plan_window_missing_and_existing(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    w = I.plan_window(spark, path, F.col("d"), 5, 35, full_load_start="2022-01-01")
    assert (w.exists, w.start, w.cut) == (False, dt.date(2022, 1, 1), dt.date(2022, 2, 5))
    I.incremental_write(frame(spark, 10, 1), path, "d", w)
    w2 = I.plan_window(spark, path, I.partition_date(), 5, 0)
    assert w2.exists and w2.max_date == dt.date(2024, 10, 7) and w2.start == dt.date(2024, 10, 2)
    w3 = I.plan_window(spark, path, I.partition_date(), 100, 0, floor="2024-09-01")
    assert w3.start == dt.date(2024, 9, 1)           # clamped, table exists


def test_rerun_idempotent_and_other_partitions_untouched(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    first = I.IncrementalWindow(False, None, dt.date(2024, 1, 1), dt.date(2024, 1, 1))
    I.incremental_write(frame(spark, 10, 1), path, "d", first)
    later = I.IncrementalWindow(True, dt.date(2024, 10, 7), dt.date(2024, 10, 5), dt.date(2024, 10, 5))
    for _ in range(2):
        I.incremental_write(frame(spark, 10, 2), path, "d", later, num_partitions=2)
    back = spark.read.parquet(path)
    got = {(r.d, r.v) for r in back.collect()}
    assert len(got) == 10
    assert all(v == (2 if d >= dt.date(2024, 10, 5) else 1) for d, v in got)
    # month 9 -> 10 with unpadded ints on re-read: partition_date still orders correctly
    mx = back.agg(F.max(I.partition_date())).first()[0]
    assert mx == dt.date(2024, 10, 7)
    assert {type(r.month_partition) for r in back.select("month_partition").collect()} == {int}


def test_window_frame_floor(spark):
    df = frame(spark, 3, 0)
    r = I.window_frame(df, F.col("d"), 5, 35, floor="2024-09-01").first()
    assert (r.max_date, r.start, r.cut) == (dt.date(2024, 9, 30), dt.date(2024, 9, 1), dt.date(2024, 10, 6))
