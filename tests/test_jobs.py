import datetime as dt
import os

from pyspark.sql import functions as F

from ledgerlens.operators import activity
from ledgerlens.plans import jobs
from ledgerlens.plans.fixtures import RULES
from test_cashback import P, frames

T = dt.datetime


def test_cashback_job_incremental_and_idempotent(spark, tmp_dir):
    tables, promo, taxonomy, instant, events, core = frames(spark)
    src = dict(payment_tables=tables, promo=promo, taxonomy=taxonomy, instant=instant, events=events, core=core)
    target = os.path.join(tmp_dir, "cashback")
    w1 = jobs.cashback_job(spark, src, target, P, delta_days=100, floor="2024-11-01",
                           full_load_start="2024-01-01", dedupe_order=["id"])
    assert not w1.exists and w1.start == dt.date(2024, 1, 1)
    first = {tuple(r) for r in spark.read.parquet(target).collect()}
    w2 = jobs.cashback_job(spark, src, target, P, delta_days=100, floor="2024-11-01", dedupe_order=["id"])
    assert w2.exists and w2.start == dt.date(2024, 11, 1)          # clamped to the floor
    again = {tuple(r) for r in spark.read.parquet(target).collect()}
    assert again == first and len(first) == 8


def test_storyline_job(spark, tmp_dir):
    from test_subscription import HIST, SUBS
    subs = spark.createDataFrame([(1, 1, 1, "Harbour Yearly", "SUBSCRIBED", T(2024, 3, 1), T(2024, 3, 1), None)], SUBS)
    hist = spark.createDataFrame([(1, 1, "Harbour Yearly", None, "SUBSCRIBED", T(2024, 3, 1), 1)], HIST)
    jobs.storyline_job(subs, hist, "ll_story_job", RULES, created_from="2024-01-01", calendar_start="2024-01-01",
                       as_of="2024-03-05", history_tie_breakers=["seq"], path=os.path.join(tmp_dir, "story"))
    t = spark.table("ll_story_job")
    assert t.count() == 5 and t.columns[0] == "storyline_id"


def test_rolling_metric_job(spark, tmp_dir):
    rows = [(c % 7, dt.date(2024, 1, 1) + dt.timedelta(days=c % 60), "p") for c in range(300)]
    act = spark.createDataFrame(rows, "consumer_id long, created_date date, g string")
    target = os.path.join(tmp_dir, "mat")
    kw = dict(group_cols=["g"], window_days=7, kpi="wat", delta_days=5, full_load_start="2024-01-01",
              as_of="2024-03-01", writers=2)
    jobs.rolling_metric_job(spark, act, target, **kw)
    first = {(r.g, r.calendar_date, r.wat_7) for r in spark.read.parquet(target).collect()}
    w = jobs.rolling_metric_job(spark, act, target, **kw)
    assert w.exists
    again = {(r.g, r.calendar_date, r.wat_7) for r in spark.read.parquet(target).collect()}
    assert again == first and max(d for _, d, _ in first) == dt.date(2024, 2, 29)
    assert spark.read.parquet(target).where(F.col("wat_7") <= 0).count() == 0


def _metric(spark, rows, as_of, k=7):
    frame = spark.createDataFrame(rows, "consumer_id long, created_date date, g string")
    out = activity.rolling_active_users(frame, group_cols=["g"], window_days=k, kpi="wat", start="2024-01-01", as_of=as_of)
    return {(r.g, r.calendar_date, r.wat_7) for r in out.collect()}


def test_incremental_equals_full_with_gaps_late_rows_and_vanished_days(spark, tmp_dir):
    day = lambda m, d: dt.date(2024, m, d)
    early = [(c, day(1, 1 + c), "p") for c in range(20)] + [(50, day(2, 14), "p"), (51, day(2, 24), "p"), (52, day(2, 26), "p")]
    late = [r for r in early if r[0] != 52] + [(53, day(2, 24), "p")]    # a gap Feb 15-23, a late consumer, one that vanished
    target = os.path.join(tmp_dir, "gaps")
    kw = dict(group_cols=["g"], window_days=7, kpi="wat", delta_days=5, full_load_start="2024-01-01", writers=2)
    schema = "consumer_id long, created_date date, g string"
    jobs.rolling_metric_job(spark, spark.createDataFrame(early, schema), target, as_of="2024-02-29", **kw)
    jobs.rolling_metric_job(spark, spark.createDataFrame(late, schema), target, as_of="2024-02-29", **kw)
    got = {(r.g, r.calendar_date, r.wat_7) for r in spark.read.parquet(target).collect()}
    cut = day(2, 28) - dt.timedelta(days=5)
    assert {x for x in got if x[1] >= cut} == {x for x in _metric(spark, late, "2024-02-29") if x[1] >= cut}
    # all rows of the rewritten range go: the days must not stay
    none = [r for r in late if r[1] < day(2, 1)]
    jobs.rolling_metric_job(spark, spark.createDataFrame(none, schema), target, as_of="2024-02-29", **kw)
    left = {r.calendar_date for r in spark.read.parquet(target).collect()}
    assert max(left) < cut


def test_an_empty_target_is_a_full_load(spark, tmp_dir):
    target = os.path.join(tmp_dir, "empty")
    schema = "consumer_id long, created_date date, g string"
    kw = dict(group_cols=["g"], window_days=7, kpi="wat", delta_days=5, full_load_start="2024-01-01", as_of="2024-03-01")
    spark.createDataFrame([], "calendar_date date, wat_7 long, year_partition string, month_partition string, day_partition string").write.partitionBy(
        "year_partition", "month_partition", "day_partition").parquet(target)
    from ledgerlens.streaming import incremental
    assert not incremental.plan_window(spark, target, incremental.partition_date(), 5).exists
    rows = [(c % 9, dt.date(2024, 1, 1) + dt.timedelta(days=c), "p") for c in range(50)]
    w = jobs.rolling_metric_job(spark, spark.createDataFrame(rows, schema), target, **kw)
    assert not w.exists
    got = {(r.g, r.calendar_date, r.wat_7) for r in spark.read.parquet(target).collect()}
    assert got == {x for x in _metric(spark, rows, "2024-03-01") if x[1] >= w.cut}
