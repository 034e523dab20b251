"""Incremental batch loads with a date watermark.

The reference has no Structured Streaming; its late-data handling is a batch
rewrite of the last days of a date-partitioned table. This module provides:

* ``window_frame``: a one-row DataFrame (max date of the target, start, cut)
  computed lazily from the target table;
* ``plan_window``: the same values as Python dates for the driver (one row);
* ``incremental_write``: keeps rows on or after the cut, adds y/M/d partition
  strings and replaces the days from the cut on as a range.

Rerunning a load for the same days is idempotent: dynamic partition overwrite
replaces the days of the new frame, and days of the range that the frame no
longer has are dropped, so an incremental run leaves what a full one would.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import DateLike, date_lit, to_py_date
from ..session import ensure_checkpoint_dir
from ..sources.sinks import PARTITION_COLUMNS, drop_days, need_plain_files, newest_partition, with_date_partitions, write_partitioned


@dataclass(frozen=True)
class IncrementalWindow:
    exists: bool
    max_date: _dt.date | None
    start: _dt.date
    cut: _dt.date


def partition_date(year_col: str = "year_partition", month_col: str = "month_partition",
                   day_col: str = "day_partition") -> Column:
    """The date of y/M/d partition columns, whether re-read as ints or strings.

    (A string max over 'y-M-d' concatenations is wrong once the values are
    unpadded ints, e.g. '2024-9-30' > '2024-10-01'.)
    """
    return F.make_date(F.col(year_col).cast("int"), F.col(month_col).cast("int"), F.col(day_col).cast("int"))


def window_frame(target: DataFrame, date_expr: Column, delta_days: int, buffer_days: int = 0,
                 floor: DateLike | None = None) -> DataFrame:
    """One row: ``max_date``, ``start = max - (delta + buffer)`` (not before
    ``floor``), ``cut = start + buffer``. A global max: partial per task."""
    m = target.agg(F.max(date_expr).alias("max_date"))
    start = F.date_sub(F.col("max_date"), delta_days + buffer_days)
    if floor is not None:
        start = F.greatest(start, date_lit(floor))
    return m.select("max_date", start.alias("start")).select(
        "max_date", "start", F.date_add(F.col("start"), buffer_days).alias("cut"))


def plan_window(spark: SparkSession, path: str | None, date_expr: Column | None, delta_days: int, buffer_days: int = 0,
                full_load_start: DateLike = "2022-01-01", floor: DateLike | None = None,
                fmt: str = "parquet", target: DataFrame | None = None) -> IncrementalWindow:
    """Where the next load starts.

    Existing target: start = max date - (delta + buffer), clamped to ``floor``;
    missing target (path not found) or an empty one: ``full_load_start``,
    without clamp. cut = start + buffer: rows before it only warm up rolling
    metrics and are not written. Without ``date_expr`` the newest day comes
    from the y/M/d folders of ``path``: a listing, no scan.
    """
    if date_expr is None:
        need_plain_files(fmt)
        newest = newest_partition(spark, path)
        if newest is None:
            return first_window(full_load_start, buffer_days)
        day = _dt.date(*map(int, newest))
        start = day - _dt.timedelta(days=delta_days + buffer_days)
        if floor is not None:
            start = max(start, to_py_date(floor))
        return IncrementalWindow(True, day, start, start + _dt.timedelta(days=buffer_days))
    if target is None:
        try:
            target = spark.read.format(fmt).load(path)
        except AnalysisException as exc:
            # a target that a load of no rows left has folders but no schema
            if not any(m in str(exc) for m in ("PATH_NOT_FOUND", "does not exist", "UNABLE_TO_INFER_SCHEMA")):
                raise
            target = None
    row = window_frame(target, date_expr, delta_days, buffer_days, floor).first() if target is not None else None
    if row is None or row["max_date"] is None:
        return first_window(full_load_start, buffer_days)
    return IncrementalWindow(True, row["max_date"], row["start"], row["cut"])


def first_window(full_load_start: DateLike, buffer_days: int) -> IncrementalWindow:
    start = to_py_date(full_load_start)
    return IncrementalWindow(False, None, start, start + _dt.timedelta(days=buffer_days))


def replace_days(df: DataFrame, path: str, date_col: str, first: _dt.date, last: _dt.date | None = None, fmt: str = "parquet",
                 num_partitions: int | None = None) -> None:
    """Replace the days from ``first`` to ``last`` (default: the newest of table and frame) by the frame's rows.

    ``df`` has the y/M/d partition columns and is written as it is; it is
    materialised once. The days it has are one value per day of the range.
    Readers of the folder may see the range half replaced; ``loads`` swaps it
    in a catalog table instead. Formats with a log of their own are refused.
    """
    need_plain_files(fmt)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    df = df.checkpoint(eager=True)
    present = {r[0] for r in df.select(F.to_date(date_col)).distinct().collect()}
    newest = newest_partition(spark, path)
    ends = [d for d in (last, _dt.date(*map(int, newest)) if newest else None) if d is not None]
    if present:
        write_partitioned(df, path, PARTITION_COLUMNS, fmt, num_partitions=num_partitions)
    if newest:
        end = min(ends) if last is not None else max(ends)
        days = (first + _dt.timedelta(days=i) for i in range((end - first).days + 1))
        drop_days(spark, path, (d for d in days if d not in present))


def incremental_write(df: DataFrame, path: str, date_col: str, window: IncrementalWindow,
                      until: DateLike | None = None, fmt: str = "parquet",
                      num_partitions: int | None = None) -> None:
    """Write rows with ``cut <= date`` (and ``date <= until``) to y/M/d partitions.

    The whole range of days is replaced: days without rows lose their old ones.
    ``num_partitions``: see ``write_partitioned``.
    """
    cond = F.col(date_col) >= F.lit(window.cut)
    if until is not None:
        cond = cond & (F.col(date_col) <= date_lit(until))
    replace_days(with_date_partitions(df.where(cond), date_col), path, date_col, window.cut,
                 to_py_date(until) if until is not None else None, fmt, num_partitions)


def full_load(df: DataFrame, path: str, date_col: str, start: DateLike, buffer_days: int = 0,
              fmt: str = "parquet", num_partitions: int | None = None) -> IncrementalWindow:
    """Replace the whole table with the rows from ``start + buffer_days`` on.

    The full-load branch of an incremental job: a static overwrite, so
    partitions left by earlier runs do not survive.
    """
    first = to_py_date(start)
    w = IncrementalWindow(False, None, first, first + _dt.timedelta(days=buffer_days))
    out = with_date_partitions(df.where(F.col(date_col) >= F.lit(w.cut)), date_col)
    write_partitioned(out, path, PARTITION_COLUMNS, fmt, num_partitions=num_partitions, dynamic=False)
    return w
