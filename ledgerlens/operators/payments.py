"""Payment transaction jobs: approved base, first-days selection, method aggregate,
month-window enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import payment_method_class
from ..functions.dates import DateLike, date_lit


def approved_base(df: DataFrame, consumer_col: str = "consumer_id", ts_col: str = "created_at",
                  keep: Sequence[str] = ("product_type_name",), approved_col: str | None = "is_approved",
                  since: DateLike | None = None) -> DataFrame:
    """Approved transactions since a date: ``(consumer_id, created_date, *keep)``."""
    cond = F.lit(True)
    if approved_col:
        cond = cond & (F.col(approved_col) == F.lit(True))
    if since is not None:
        cond = cond & (F.col(ts_col) >= date_lit(since))
    return df.where(cond).select(F.col(consumer_col).alias("consumer_id"),
                                 F.to_date(ts_col).alias("created_date"), *keep)


def first_days_transactions(df: DataFrame, day_limit: int = 7, ts_col: str = "adjusted_created_at",
                            user_col: str = "user_id", installments_col: str = "installments",
                            method_col: str = "payment_method", value_col: str = "paid_total_value_with_revenue",
                            type_col: str = "pix_transaction_type", type_value: str = "PF",
                            shift_days: int = 7) -> DataFrame:
    """Transactions of the first ``day_limit`` days of each month, of one type.

    Output: ``data, user_id, data_7 (date + shift_days), metodo_pagamento, tpv``.
    """
    ts = F.col(ts_col)
    return (df.where((F.col(type_col) == type_value) & (F.dayofmonth(ts) <= day_limit))
              .select(ts.alias("data"), F.col(user_col).alias("user_id"),
                      F.date_add(ts, shift_days).alias(f"data_{shift_days}"),
                      payment_method_class(installments_col, method_col).alias("metodo_pagamento"),
                      F.col(value_col).alias("tpv")))


def method_aggregate(df: DataFrame, group_cols: Sequence[str] = ("metodo_pagamento",),
                     value_col: str = "tpv", user_col: str = "user_id") -> DataFrame:
    """TPV, transactions, distinct users and average ticket (TPV / users, 2 dp)."""
    agg = df.groupBy(*group_cols).agg(
        F.sum(value_col).alias("tpv"), F.count(F.lit(1)).alias("transactions"),
        F.count_distinct(user_col).alias("users"))
    return agg.withColumn("avg_ticket", F.round(F.try_divide(F.col("tpv"), F.col("users")), 2))


def month_window_enriched(tx: DataFrame, registers: DataFrame, calendar: DataFrame, key: str,
                          ts_col: str, analysis_months: int, frequency_months: int,
                          as_of: DateLike = None, approved: F.Column | None = None) -> DataFrame:
    """Transactions of the last ``analysis + frequency - 1`` months up to ``as_of``
    (excluded), with register columns (left join on ``key``) and calendar
    attributes (left join on the day, the calendar broadcast: it has one row
    per day, so its size is bounded by the date range)."""
    ref = date_lit(as_of)
    first = F.add_months(F.trunc(ref, "month"), -(analysis_months + frequency_months - 1))
    day = F.to_date(ts_col)
    cond = (day >= first) & (day < ref)
    if approved is not None:
        cond = cond & approved
    base = tx.where(cond).withColumn("calendar_date", day)
    # Only the window's days are broadcast: at most (months + 1) * 31 rows.
    days = calendar.where((F.col("calendar_date") >= first) & (F.col("calendar_date") < ref))
    return (base.join(registers, on=key, how="left")
                .join(F.broadcast(days), on="calendar_date", how="left"))
