"""Date helpers: reference date, calendar, month labels, month-to-date flag.

Every job takes an explicit ``as_of`` date instead of calling
``current_date()`` inside the plan, so reruns and tests are reproducible.
``as_of=None`` means "today" (``current_date()``).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DateLike = _dt.date | str | Column | None


def date_lit(value: DateLike) -> Column:
    """A date Column from a literal, an ISO string, a Column, or ``None`` (today)."""
    if value is None:
        return F.current_date()
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, _dt.datetime):
        value = value.date()
    if isinstance(value, _dt.date):
        value = value.isoformat()
    return F.expr(f"DATE'{to_py_date(value).isoformat()}'")


def to_py_date(value: _dt.date | str) -> _dt.date:
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    return _dt.date.fromisoformat(str(value)[:10])


def calendar(spark: SparkSession, start: DateLike, end: DateLike, include_end: bool = True) -> DataFrame:
    """Calendar dimension ``(calendar_date, is_month_end)`` for [start, end].

    The frame has one row per day, so its size is bounded by the date range,
    not by any fact table; it is safe to broadcast.
    """
    stop = date_lit(end) if include_end else F.date_sub(date_lit(end), 1)
    days = spark.range(1).select(
        F.explode(F.sequence(date_lit(start), stop, F.expr("interval 1 day"))).alias("calendar_date")
    )
    return days.select(
        "calendar_date",
        (F.col("calendar_date") == F.last_day("calendar_date")).alias("is_month_end"),
    )


def month_start(c: Column | str) -> Column:
    """First day of the month, as a date (``date(date_trunc('MONTH', c))``)."""
    return F.trunc(F.to_date(c) if isinstance(c, str) else c.cast("date"), "month")


def later_of(a: Column, b: Column) -> Column:
    """``case when a > b then a else b end``.

    Unlike ``greatest`` this keeps a null ``b`` as null (and a null ``a``
    yields ``b``), which the subscription jobs rely on.
    """
    return F.when(a > b, a).otherwise(b)


def shift_hours(ts: Column | str, hours: int) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_add("HOUR", F.lit(hours), c)


def is_month_end_or(d: Column, as_of: DateLike) -> Column:
    """``d = last_day(d) or d = as_of``: the last status of each month."""
    return (d == F.last_day(d)) | (d == date_lit(as_of))


def mtd_flag(d: Column | str, as_of: DateLike = None) -> Column:
    """Month-to-date comparability: day of month of ``d`` <= that of ``as_of``.

    A null date gives ``False``, as the reference's CASE does.
    """
    c = F.col(d) if isinstance(d, str) else d
    return F.coalesce(F.dayofmonth(c) <= F.dayofmonth(date_lit(as_of)), F.lit(False))


def month_labels(df: DataFrame, date_col: str, n: int = 8, fmt: str = "yyyy/MM",
                 prefix: str = "m_") -> DataFrame:
    """One row: the reference month (max of ``date_col``) and ``m_0..m_{n-1}``.

    ``m_i`` is the ``fmt`` label of the reference date minus ``i`` months. The
    max is a global aggregate (partial per task, one tiny final merge).
    """
    ref = df.agg(F.max(date_col).alias("mes_referencia"))
    return ref.select(
        "mes_referencia",
        *[F.date_format(F.add_months("mes_referencia", -i), fmt).alias(f"{prefix}{i}") for i in range(n)],
    )
