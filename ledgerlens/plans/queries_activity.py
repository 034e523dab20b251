"""Registered queries: rolling active users and trailing distinct counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import activity
from ..sources.tables import ParquetTables
from . import fixtures as fx
from .catalog import register


# --- A1 rolling active users --------------------------------------------------

def _rolling_sql(base_sql: str, group: str, k: int, kpi: str, start: str, as_of: str) -> str:
    return f"""
WITH base AS ({base_sql}),
act AS (SELECT DISTINCT consumer_id, grp, created_date FROM base
        WHERE consumer_id IS NOT NULL AND created_date IS NOT NULL),
cal AS (SELECT CAST(d AS DATE) AS calendar_date
        FROM generate_series(DATE '{start}', DATE '{as_of}' - INTERVAL 1 DAY, INTERVAL 1 DAY) t(d)),
lo AS (SELECT min(created_date) AS m FROM base)
SELECT a.grp AS {group}, c.calendar_date, CAST(count(DISTINCT a.consumer_id) AS BIGINT) AS {kpi}_{k}
FROM act a JOIN cal c
  ON c.calendar_date >= a.created_date AND c.calendar_date <= a.created_date + {k - 1}
WHERE c.calendar_date > (SELECT m FROM lo) + {k}
GROUP BY 1, 2
"""


_EVENTS_BASE = "SELECT user_id AS consumer_id, event_type AS grp, CAST(ts AS DATE) AS created_date FROM events"
_ORDERS_BASE = ("SELECT o_custkey AS consumer_id, o_orderpriority AS grp, "
                "CAST(o_orderdate AS DATE) AS created_date FROM orders")


def _events_rolling(k: int, kpi: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = ParquetTables(spark, sf_dir)
        return activity.rolling_active_users(
            fx.events_activity(t), consumer_col="consumer_id", date_col="created_date",
            group_cols=["event_type", "calendar_date"], window_days=k, kpi=kpi,
            start=fx.EVENTS_START, as_of=fx.EVENTS_AS_OF)
    return run


register("rolling_active_1", _rolling_sql(_EVENTS_BASE, "event_type", 1, "dau", fx.EVENTS_START, fx.EVENTS_AS_OF))(
    _events_rolling(1, "dau"))
register("rolling_active_7", _rolling_sql(_EVENTS_BASE, "event_type", 7, "wau", fx.EVENTS_START, fx.EVENTS_AS_OF))(
    _events_rolling(7, "wau"))


@register("rolling_active_35", _rolling_sql(_ORDERS_BASE, "o_orderpriority", 35, "mau",
                                            fx.ORDERS_START, fx.ORDERS_AS_OF))
def rolling_active_35(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ParquetTables(spark, sf_dir)
    orders = t("orders").select(F.col("o_custkey").alias("consumer_id"),
                                F.to_date("o_orderdate").alias("created_date"), "o_orderpriority")
    return activity.rolling_active_users(
        orders, group_cols=["o_orderpriority", "calendar_date"], window_days=35, kpi="mau",
        start=fx.ORDERS_START, as_of=fx.ORDERS_AS_OF)


@register("trailing_distinct", f"""
SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS qtt
FROM events
WHERE ts >= DATE '{fx.EVENTS_AS_OF}' - INTERVAL 7 DAY AND CAST(ts AS DATE) < DATE '{fx.EVENTS_AS_OF}'
GROUP BY 1
""")
def trailing_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ParquetTables(spark, sf_dir)
    return activity.trailing_distinct(t("events"), consumer_col="user_id", ts_col="ts",
                                      group_cols=["event_type"], days=7, as_of=fx.EVENTS_AS_OF)
