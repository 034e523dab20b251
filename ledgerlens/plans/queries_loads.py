"""Registered queries: audience split, stratified sample, incremental loads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import activity, audience
from ..session import scratch_path
from ..sources.tables import ParquetTables
from ..streaming import incremental, loads
from ..streaming.rolling_state import RollingState
from . import fixtures as fx
from .catalog import register
from .queries_activity import _ORDERS_BASE, _rolling_sql

STRATA = ("click", "view", "purchase")


# The first caps bind at any scale of the tables; the large one is a cap of the usual size.
_SPLIT_SEED, _SAMPLE_SEED, _CAP, _LARGE_CAP = 7, 123, 25, 10_000
_IN_STRATA = ", ".join(f"'{s}'" for s in STRATA)


def _bits_sql(*exprs: str, seed: int) -> str:
    text = "concat_ws('|', " + ", ".join(exprs) + f", '{seed}')"
    return f"CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT)"


_T = audience.split_thresholds((0.1, 0.1, 0.1))


@register("audience_split", f"""
WITH h AS (SELECT user_id, {_bits_sql('CAST(user_id AS VARCHAR)', seed=_SPLIT_SEED)} AS v
           FROM (SELECT DISTINCT user_id FROM events
                 WHERE event_type IN ({_IN_STRATA}) AND user_id IS NOT NULL)),
g AS (SELECT user_id, CASE WHEN v < {_T[0]} THEN 'Grupo 1' WHEN v < {_T[1]} THEN 'Grupo 2'
                           ELSE 'Grupo 3' END AS grupos, v FROM h)
SELECT user_id, grupos FROM g
QUALIFY row_number() OVER (PARTITION BY grupos ORDER BY v, user_id) <= {_CAP}
""")
def audience_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = ParquetTables(spark, sf_dir)("events")
    return audience.audience_split(ev, "user_id", weights=(0.1, 0.1, 0.1), cap=_CAP, seed=_SPLIT_SEED,
                                   where=F.col("event_type").isin(*STRATA))


@register("audience_split_large", f"""
WITH h AS (SELECT k, {_bits_sql('CAST(k AS VARCHAR)', seed=_SPLIT_SEED)} AS v
           FROM (SELECT DISTINCT l_orderkey * 16 + l_linenumber AS k FROM lineitem)),
g AS (SELECT k, CASE WHEN v < {_T[0]} THEN 'Grupo 1' WHEN v < {_T[1]} THEN 'Grupo 2' ELSE 'Grupo 3' END AS grupos, v FROM h)
SELECT k, grupos FROM g QUALIFY row_number() OVER (PARTITION BY grupos ORDER BY v, k) <= {_LARGE_CAP}
""")
def audience_split_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ParquetTables(spark, sf_dir)("lineitem").select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("k"))
    return audience.audience_split(lines, "k", weights=(0.1, 0.1, 0.1), cap=_LARGE_CAP, seed=_SPLIT_SEED)


@register("stratified_sample", f"""
WITH h AS (SELECT DISTINCT user_id, event_type,
                  {_bits_sql('CAST(user_id AS VARCHAR)', 'event_type', seed=_SAMPLE_SEED)} AS v
           FROM events WHERE event_type IN ({_IN_STRATA}))
SELECT user_id, event_type FROM h
WHERE v < {audience.fraction_threshold(0.5)}
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY v, user_id) <= {_CAP}
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = ParquetTables(spark, sf_dir)("events")
    return audience.stratified_sample(ev, "event_type", "user_id", strata=STRATA, fraction=0.5,
                                      seed=_SAMPLE_SEED, cap=_CAP)


@register("stratified_sample_large", f"""
WITH h AS (SELECT DISTINCT l_orderkey * 16 + l_linenumber AS k, l_returnflag,
                  {_bits_sql('CAST(l_orderkey * 16 + l_linenumber AS VARCHAR)', 'l_returnflag', seed=_SAMPLE_SEED)} AS v FROM lineitem)
SELECT k, l_returnflag FROM h WHERE v < {audience.fraction_threshold(0.5)}
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY v, k) <= {_LARGE_CAP}
""")
def stratified_sample_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the lines of each return flag, 10,000 at most."""
    lines = ParquetTables(spark, sf_dir)("lineitem").select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("k"), "l_returnflag")
    return audience.stratified_sample(lines, "l_returnflag", "k", fraction=0.5, seed=_SAMPLE_SEED, cap=_LARGE_CAP)


@register("random_split", "SELECT o_orderkey, count(*) AS n_rows, TRUE AS labelled FROM orders GROUP BY o_orderkey")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three random groups: every row is in one of them, once, under its label."""
    groups = audience.random_split_groups(ParquetTables(spark, sf_dir)("orders").select("o_orderkey"), (0.1, 0.1, 0.1), seed=_SPLIT_SEED)
    return groups.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_rows"), F.every(F.col("grupos").isin("Grupo 1", "Grupo 2", "Grupo 3")).alias("labelled"))


_DELTA, _BUFFER = 5, 35


@register("incremental_window", f"""
WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS max_date FROM orders)
SELECT max_date, max_date - {_DELTA + _BUFFER} AS start, max_date - {_DELTA + _BUFFER} + {_BUFFER} AS cut FROM m
""")
def incremental_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ParquetTables(spark, sf_dir)("orders")
    return incremental.window_frame(o, F.to_date("o_orderdate"), _DELTA, _BUFFER)


_FLOOR = "2001-06-01"


@register("incremental_window_partitions", f"""
WITH m AS (SELECT max(make_date(year(o_orderdate), month(o_orderdate), day(o_orderdate))) AS max_date FROM orders)
SELECT max_date, greatest(max_date - 100, DATE '{_FLOOR}') AS start,
       greatest(max_date - 100, DATE '{_FLOOR}') AS cut FROM m
""")
def incremental_window_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A target stored with int y/M/d partition columns, as parquet re-reads them.
    o = ParquetTables(spark, sf_dir)("orders").select(
        F.year("o_orderdate").alias("year_partition"), F.month("o_orderdate").alias("month_partition"),
        F.dayofmonth("o_orderdate").alias("day_partition"))
    return incremental.window_frame(o, incremental.partition_date(), 100, 0, floor=_FLOOR)


def _orders_activity(t: ParquetTables) -> DataFrame:
    return t("orders").select(F.col("o_custkey").alias("consumer_id"), F.to_date("o_orderdate").alias("created_date"),
                              "o_orderpriority")


def _mau(df: DataFrame, as_of: str, first=None) -> DataFrame:
    return activity.rolling_active_users(df, group_cols=["o_orderpriority"], window_days=35, kpi="mau",
                                         start=fx.ORDERS_START, as_of=as_of, min_date=first)


_FIRST_LOAD = "2001-07-15"


@register("partition_overwrite", "SELECT *, CAST(year(calendar_date) AS INTEGER) AS year_partition, "
          "CAST(month(calendar_date) AS INTEGER) AS month_partition, "
          "CAST(day(calendar_date) AS INTEGER) AS day_partition FROM ("
          + _rolling_sql(_ORDERS_BASE, "o_orderpriority", 35, "mau", fx.ORDERS_START, fx.ORDERS_AS_OF) + ")")
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads: the days before ``_FIRST_LOAD``, then an incremental one up to the end; the table is read back.

    The result must be that of one full load. Each call has a table of its own
    in the shared checkpoint folder.
    """
    orders = _orders_activity(ParquetTables(spark, sf_dir))
    path = scratch_path(spark, "mau-35")
    # At most one row per priority and day: a fixed hash split by day is safe.
    writers = int(spark.conf.get("spark.sql.shuffle.partitions"))
    early = orders.where(F.col("created_date") < F.lit(_FIRST_LOAD).cast("date"))
    incremental.full_load(_mau(early, _FIRST_LOAD), path, "calendar_date", fx.ORDERS_START, _BUFFER, num_partitions=writers)
    w = incremental.plan_window(spark, path, None, _DELTA, _BUFFER)
    first = orders.agg(F.min("created_date")).scalar()
    incremental.incremental_write(_mau(orders.where(F.col("created_date") >= F.lit(w.start)), fx.ORDERS_AS_OF, first), path,
                                  "calendar_date", w, num_partitions=writers)
    return spark.read.parquet(path)


@register("rolling_state_35", _rolling_sql(_ORDERS_BASE, "o_orderpriority", 35, "mau", fx.ORDERS_START, fx.ORDERS_AS_OF))
def rolling_state_35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling metric after three runs: all but the last months, a month with holes, then the rest with the month's late rows."""
    orders = _orders_activity(ParquetTables(spark, sf_dir))
    day = F.col("created_date")
    early, month = day < F.lit("2001-06-01").cast("date"), day < F.lit("2001-07-01").cast("date")
    late = F.col("consumer_id") % 3 == 0
    state = RollingState(scratch_path(spark, "rolling-35"), ("o_orderpriority",), 35, late_days=70)
    for part in (orders.where(early), orders.where(~early & month & ~late), orders.where(~early & (~month | late))):
        state.run(part)
    return state.metric(spark, fx.ORDERS_START, fx.ORDERS_AS_OF)


# A table loaded four times: without July's second half, without July, without
# anything after March, and whole. The second run finds an emptied month, the third
# has no row in its window, the last begins right after what these two removed.
_LOADS = (("2001-07-15", "2001-07-14"), ("2001-07-01", "2001-07-20"), ("2001-04-01", "2001-07-20"), (None, fx.ORDERS_AS_OF))
_LOAD_DELTA = 30


def _daily_totals(t: ParquetTables, before: str | None) -> DataFrame:
    o = t("orders").select("o_orderpriority", F.to_date("o_orderdate").alias("order_date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("_cents"))
    if before:
        o = o.where(F.col("order_date") < F.lit(before).cast("date"))
    return o.groupBy("order_date", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.sum("_cents").alias("cents"))


def _run_loads(spark: SparkSession, sf_dir: str) -> loads.Target:
    """The four loads into a table of its own below the shared checkpoint folder."""
    t = ParquetTables(spark, sf_dir)
    target = loads.Target(f"order_totals_{uuid.uuid4().hex}", scratch_path(spark, "order-totals"), grain="month")
    writers = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a row a priority and day
    for before, until in _LOADS:
        w = loads.plan_window(spark, target, _LOAD_DELTA, full_load_start=fx.ORDERS_START)
        loads.load_window(_daily_totals(t, before), target, "order_date", w, until, writers)
    return target


_TOTALS_SQL = """SELECT CAST(o_orderdate AS DATE) AS order_date, o_orderpriority, count(*) AS orders,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2"""


@register("load_swap", f"SELECT *, strftime(order_date, '%Y') AS year_partition, strftime(order_date, '%m') AS month_partition FROM ({_TOTALS_SQL})")
def load_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after the four loads, read from the catalog: the rows of one full load."""
    return spark.table(_run_loads(spark, sf_dir).table)


@register("load_journal", f"""
WITH t AS ({_TOTALS_SQL}),
a AS (SELECT max(order_date) AS d FROM t WHERE order_date < DATE '2001-07-15'),
b AS (SELECT date_trunc('month', d - {_LOAD_DELTA})::DATE AS f, (SELECT max(order_date) FROM t WHERE order_date < DATE '2001-07-01') AS d FROM a),
c AS (SELECT date_trunc('month', d - {_LOAD_DELTA})::DATE AS f FROM b),
c2 AS (SELECT f, (SELECT max(order_date) FROM t WHERE order_date < f) AS d FROM c),
e AS (SELECT date_trunc('month', d - {_LOAD_DELTA})::DATE AS f, (SELECT max(order_date) FROM t) AS d FROM c2)
SELECT CAST(1 AS INTEGER) AS load, CAST(NULL AS DATE) AS first_day, CAST(NULL AS DATE) AS last_day, d AS newest_day,
       (SELECT count(*) FROM t WHERE order_date < DATE '2001-07-15') AS n_rows FROM a
UNION ALL SELECT 2, f, DATE '2001-07-31', d, (SELECT count(*) FROM t WHERE order_date BETWEEN b.f AND DATE '2001-06-30') FROM b
UNION ALL SELECT 3, f, DATE '2001-07-31', d, 0 FROM c2
UNION ALL SELECT 4, f, DATE '2001-08-31', d, (SELECT count(*) FROM t WHERE order_date >= e.f) FROM e
""")
def load_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the four loads wrote down: the windows right after an emptied month and an empty load."""
    return loads.journal(spark, _run_loads(spark, sf_dir)).drop("folder")
