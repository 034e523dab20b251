"""Registered queries: paging, reshape, profiles, month labels, payment jobs
(A2, A3, A4, A10, A11, A12, A13, A14, A15, A42)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dates
from ..operators import payments, profile, rank, reshape
from ..session import scratch_path
from ..sources import page_index
from ..sources.tables import ParquetTables
from . import fixtures as fx
from .catalog import register

PAGE_FIRST, PAGE_LAST = 101, 250


_PAGE_SQL = f"""
SELECT o.*, r.dense_rank
FROM orders o
JOIN (SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey NULLS FIRST) AS dense_rank
      FROM (SELECT DISTINCT o_custkey FROM orders)) r
  ON o.o_custkey IS NOT DISTINCT FROM r.o_custkey
WHERE r.dense_rank BETWEEN {PAGE_FIRST} AND {PAGE_LAST}
"""


@register("clustered_key_page", _PAGE_SQL)
def clustered_key_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same page from rows clustered by key."""
    path = scratch_path(spark, "orders-by-customer")
    page_index.write_page_index(ParquetTables(spark, sf_dir)("orders"), "o_custkey", path)
    return page_index.read_page(spark, path, PAGE_FIRST, PAGE_LAST, "o_custkey")


@register("distinct_key_page", _PAGE_SQL)
def distinct_key_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ParquetTables(spark, sf_dir)
    return rank.distinct_key_page(t("orders"), PAGE_FIRST, PAGE_LAST, key="o_custkey")


YEARS = list(range(1995, 2002))


def _priority_year_totals(t: ParquetTables) -> DataFrame:
    o = t("orders")
    return reshape.pivot(
        o.select("o_orderpriority", F.year("o_orderdate").alias("year"),
                 F.col("o_totalprice").cast("decimal(18,2)").alias("total")),
        ["o_orderpriority"], "year", F.sum("total").cast("double"), values=YEARS, other="other")


@register("pivot_years", "SELECT o_orderpriority, " + ", ".join(
    f"CAST(sum(CASE WHEN year(o_orderdate) = {y} THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS \"{y}\""
    for y in YEARS) + f", CAST(sum(CASE WHEN year(o_orderdate) NOT BETWEEN {YEARS[0]} AND {YEARS[-1]} OR o_orderdate IS NULL "
    "THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS other FROM orders GROUP BY 1")
def pivot_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priority_year_totals(ParquetTables(spark, sf_dir))


@register("unpivot_years", f"""
WITH g AS (SELECT o_orderpriority, year(o_orderdate) AS y,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
           FROM orders GROUP BY 1, 2),
p AS (SELECT DISTINCT o_orderpriority FROM orders),
ys AS (SELECT unnest(range({YEARS[0]}, {YEARS[-1] + 1})) AS y)
SELECT p.o_orderpriority, 'y' || CAST(ys.y AS VARCHAR) AS year_label, g.total
FROM p CROSS JOIN ys
LEFT JOIN g ON g.o_orderpriority = p.o_orderpriority AND g.y = ys.y
""")
def unpivot_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _priority_year_totals(ParquetTables(spark, sf_dir))
    return reshape.unpivot(wide, ["o_orderpriority"], {f"y{y}": str(y) for y in YEARS},
                           var_name="year_label", value_name="total")


_STAT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("profile_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS stddev, min({c}) AS min, quantile_disc({c}, 0.25) AS p25, quantile_disc({c}, 0.5) AS p50, "
    f"quantile_disc({c}, 0.75) AS p75, max({c}) AS max FROM lineitem"
    for c in _STAT_COLS))
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ParquetTables(spark, sf_dir)("lineitem")
    stats = profile.column_stats(lines, _STAT_COLS, quantiles=False).drop("p25", "p50", "p75")
    return stats.join(profile.exact_quantiles(lines, _STAT_COLS), "column_name", "left").select(
        "column_name", "count", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"),
        "min", "p25", "p50", "p75", "max")


@register("summary_rows", " UNION ALL ".join(
    f"SELECT '{name}' AS summary, {', '.join(f'CAST({fn}({c}) AS VARCHAR) AS {c}' for c in _STAT_COLS[:2])}, {fn}(l_returnflag)::VARCHAR AS l_returnflag FROM lineitem"
    for name, fn in (("count", "count"), ("min", "min"), ("max", "max"))))
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``summary`` of chosen columns, as text in long format."""
    return profile.summary(ParquetTables(spark, sf_dir)("lineitem"), [*_STAT_COLS[:2], "l_returnflag"], ["count", "min", "max"])


@register("table_profile", """
SELECT 'lineitem' AS table_name, (SELECT count(*) FROM lineitem) AS n_rows,
       (SELECT count(*) FROM information_schema.columns WHERE table_name = 'lineitem') AS n_cols,
       (SELECT string_agg(column_name, ',' ORDER BY column_name)
        FROM information_schema.columns WHERE table_name = 'lineitem') AS columns_sorted,
       (SELECT string_agg(column_name || ' ' || CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
                 WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date'
                 WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower(data_type) END,
                 ',' ORDER BY column_name)
        FROM information_schema.columns WHERE table_name = 'lineitem') AS schema_sorted
""")
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_profile(ParquetTables(spark, sf_dir)("lineitem"), "lineitem")


@register("month_labels", "WITH r AS (SELECT max(CAST(o_orderdate AS DATE)) AS mes_referencia FROM orders) "
          "SELECT mes_referencia, " + ", ".join(
              f"strftime(mes_referencia - INTERVAL {i} MONTH, '%Y/%m') AS m_{i}" for i in range(8)) + " FROM r")
def month_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ParquetTables(spark, sf_dir)("orders").select(F.to_date("o_orderdate").alias("created_date"))
    return dates.month_labels(o, "created_date", n=8)


_FIRST_DAYS_SQL = f"""
SELECT adjusted_created_at AS data, user_id, CAST(adjusted_created_at AS DATE) + 7 AS data_7,
       CASE WHEN TRY_CAST(installments AS INTEGER) > 1
                 AND payment_method IN ('CREDIT_CARD', 'BALANCE_AND_CREDIT_CARD') THEN 'Cartao parcelado'
            WHEN TRY_CAST(installments AS INTEGER) = 1
                 AND payment_method IN ('CREDIT_CARD', 'BALANCE_AND_CREDIT_CARD') THEN 'Cartao a vista'
            ELSE 'Saldo carteira' END AS metodo_pagamento,
       paid_total_value_with_revenue AS tpv
FROM ({fx.PIX_TRANSACTIONS_SQL}) tx
WHERE pix_transaction_type = 'PF' AND day(adjusted_created_at) <= 7
"""


def _first_days(t: ParquetTables) -> DataFrame:
    return payments.first_days_transactions(fx.pix_transactions(t), day_limit=7)


@register("first_days_payment_method", _FIRST_DAYS_SQL)
def first_days_payment_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_days(ParquetTables(spark, sf_dir))


@register("payment_aggregate", f"""
WITH f AS ({_FIRST_DAYS_SQL}),
a AS (SELECT metodo_pagamento, sum(CAST(tpv AS DECIMAL(18,2))) AS tpv_dec,
             count(*) AS transactions, count(DISTINCT user_id) AS users
      FROM f GROUP BY 1)
SELECT metodo_pagamento, CAST(tpv_dec AS DOUBLE) AS tpv, transactions, users,
       CAST(round(tpv_dec / users, 2) AS DOUBLE) AS avg_ticket
FROM a
""")
def payment_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _first_days(ParquetTables(spark, sf_dir)).withColumn("tpv", F.col("tpv").cast("decimal(18,2)"))
    agg = payments.method_aggregate(f)
    return agg.select("metodo_pagamento", F.col("tpv").cast("double").alias("tpv"), "transactions", "users",
                      F.col("avg_ticket").cast("double").alias("avg_ticket"))


_WINDOW_MONTHS = (2, 2)  # analysis months, frequency months


@register("month_window_enriched", f"""
SELECT CAST(o.o_orderdate AS DATE) AS calendar_date, o.o_custkey, o.o_orderkey, o.o_orderstatus,
       o.o_totalprice, o.o_orderdate, o.o_orderpriority, c.c_name, c.c_mktsegment, c.c_nationkey,
       (CAST(o.o_orderdate AS DATE) = last_day(CAST(o.o_orderdate AS DATE))) AS is_month_end
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
WHERE CAST(o.o_orderdate AS DATE) >= date_trunc('month', DATE '{fx.ORDERS_AS_OF}')
                                     - INTERVAL {sum(_WINDOW_MONTHS) - 1} MONTH
  AND CAST(o.o_orderdate AS DATE) < DATE '{fx.ORDERS_AS_OF}'
  AND o.o_orderstatus = 'F'
""")
def month_window_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ParquetTables(spark, sf_dir)
    registers = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment",
                                     "c_nationkey")
    cal = dates.calendar(spark, "1995-01-01", fx.ORDERS_AS_OF)
    return payments.month_window_enriched(
        t("orders"), registers, cal, key="o_custkey", ts_col="o_orderdate",
        analysis_months=_WINDOW_MONTHS[0], frequency_months=_WINDOW_MONTHS[1], as_of=fx.ORDERS_AS_OF,
        approved=F.col("o_orderstatus") == "F")


@register("approved_base", """
SELECT o_custkey AS consumer_id, CAST(o_orderdate AS DATE) AS created_date, o_orderpriority AS product_type_name
FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1998-01-01'
""")
def approved_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ParquetTables(spark, sf_dir)("orders").select(
        "o_custkey", "o_orderdate", F.col("o_orderpriority").alias("product_type_name"),
        (F.col("o_orderstatus") == "F").alias("is_approved"))
    return payments.approved_base(o, consumer_col="o_custkey", ts_col="o_orderdate",
                                  keep=("product_type_name",), since="1998-01-01")
