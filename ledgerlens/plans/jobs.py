"""End-to-end jobs: operators wired to their target tables.

Each job reads its sources as DataFrames, plans the load window from the
target (when incremental), builds the result with the operators and writes
it. The writes are the only actions; everything before is one lazy plan.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import DateLike, to_py_date
from ..operators import activity, cashback, intervals, subscription
from ..sources.sinks import write_table
from ..streaming import incremental, loads


def _window(spark: SparkSession, target: str | loads.Target, delta_days: int, buffer_days: int, full_load_start: DateLike,
            floor: DateLike | None, fmt: str) -> incremental.IncrementalWindow:
    if isinstance(target, loads.Target):
        return loads.plan_window(spark, target, delta_days, buffer_days, full_load_start, floor)
    return incremental.plan_window(spark, target, None, delta_days, buffer_days, full_load_start=full_load_start, floor=floor, fmt=fmt)


def cashback_job(spark: SparkSession, sources: dict[str, object], target: str | loads.Target, params: cashback.CashbackParams,
                 delta_days: int = 100, floor: DateLike | None = None, full_load_start: DateLike = "2024-01-01",
                 dedupe_order=None, fmt: str = "parquet") -> incremental.IncrementalWindow:
    """Incremental load of the unified cashback fact into y/M/d partitions.

    The window starts ``delta_days`` before the newest partition of
    ``target`` (never before ``floor`` once the table exists) or at
    ``full_load_start``; the fact is rebuilt from there to ``params.end`` and
    the days of that range are replaced. The joined sides are read from
    ``full_load_start`` on, so a rewrite finds the same pairs as a full load.
    ``target``: a folder, or a catalog table whose days are swapped (see ``loads``).
    ``sources``: ``payment_tables`` (dict by product name), ``promo``, ``taxonomy``, ``instant``,
    ``events``, ``core``.
    """
    w = _window(spark, target, delta_days, 0, full_load_start, floor, fmt)
    p = dataclasses.replace(params, start=w.start, join_start=full_load_start)
    branches = cashback.cashback_branches(sources["payment_tables"], sources["promo"], sources["taxonomy"],
                                          sources["instant"], sources["events"], sources["core"], p, dedupe_order)
    fact = cashback.cashback_payments(branches)
    if isinstance(target, loads.Target):
        loads.load_window(fact, target, "created_date", w, params.end)
    else:
        incremental.replace_days(fact, target, "created_date", w.cut, to_py_date(params.end), fmt)
    return w


def storyline_job(subscriptions: DataFrame, history: DataFrame, table: str,
                  rules: subscription.PackageRules, created_from: DateLike = "2023-01-01",
                  calendar_start: DateLike = "2023-01-01", as_of: DateLike = None, history_tie_breakers=(),
                  fmt: str = "parquet", path: str | None = None) -> None:
    """Full overwrite of the storyline fact with its surrogate id."""
    story = intervals.storyline_intervals(subscriptions, history, rules, created_from, calendar_start, as_of, history_tie_breakers)
    write_table(subscription.storyline_fact(intervals.on_days(story)), table, fmt=fmt, mode="overwrite", path=path)


def rolling_metric_job(spark: SparkSession, activity_df: DataFrame, target: str | loads.Target, date_col: str = "created_date",
                       group_cols=(), window_days: int = 35, kpi: str = "mat", delta_days: int = 5,
                       full_load_start: DateLike = "2022-01-01", as_of: DateLike = None,
                       writers: int | None = None, fmt: str = "parquet") -> incremental.IncrementalWindow:
    """Incremental load of a rolling active-user metric.

    Rewrites the last ``delta_days`` days; activity from ``window_days``
    earlier is read so those days have complete windows, and the warm-up
    days before the cut are not written. The first activity day is that of the
    whole source, not of the part read. ``target``: a folder, or a catalog
    table whose days are swapped (see ``loads``).
    """
    w = _window(spark, target, delta_days, window_days, full_load_start, None, fmt)
    src = activity_df.where(F.col(date_col) >= F.lit(w.start)) if w.exists else activity_df
    first = activity_df.agg(F.min(F.to_date(date_col))).scalar()
    metric = activity.rolling_active_users(src, date_col=date_col, group_cols=list(group_cols), window_days=window_days, kpi=kpi,
                                           start=full_load_start, as_of=as_of, min_date=first)
    if isinstance(target, loads.Target):
        loads.load_window(metric, target, "calendar_date", w, writers=writers)
    else:
        incremental.incremental_write(metric, target, "calendar_date", w, fmt=fmt, num_partitions=writers)
    return w
