"""Registered queries over sources and sinks (B1-B3, B6-B10, B12, C11, H1): each writes a given table in
another form below the shared checkpoint folder, reads it back through the library's reader and reports on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from ..sources import sinks, tables
from . import fixtures as fx
from .catalog import register


@register("csv_source", """
SELECT o_orderpriority AS priority, count(*) AS n, min(o_orderdate::DATE) AS first_day, max(o_orderkey) AS last_key
FROM orders GROUP BY ALL
""")
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders-csv")
    o = tables.ParquetTables(spark, sf_dir)("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), "o_orderpriority")
    o.write.option("header", "true").option("sep", ";").csv(path)
    back = tables.read_csv(spark, path, schema="k long, d date, p string", sep=";", names=["key", "day", "priority"])
    return back.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("key").alias("last_key"))


@register("catalog_partitioned_table", """
SELECT event_type, CAST(year(ts) AS INTEGER) AS year_partition, CAST(month(ts) AS INTEGER) AS month_partition, count(*) AS n, count(DISTINCT user_id) AS users
FROM events WHERE day(ts) <= 15 GROUP BY ALL
""")
def catalog_partitioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events-table")
    name = "ledgerlens_" + path.rsplit("-", 1)[1]
    ev = tables.ParquetTables(spark, sf_dir)("events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    # the day partition prunes half of the folders when the table is read
    sinks.write_table(sinks.with_date_partitions(ev, "day").hint("rebalance", *sinks.PARTITION_COLUMNS), name, path=path,
                      partition_by=list(sinks.PARTITION_COLUMNS))
    back = tables.read_table(spark, name).where(F.col("day_partition").cast("int") <= 15)
    return back.groupBy("event_type", F.col("year_partition").cast("int").alias("year_partition"),
                        F.col("month_partition").cast("int").alias("month_partition")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


TOP = 20


@register("sql_text_top_customers", f"""
WITH spend AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM orders
               WHERE o_orderdate >= DATE '{fx.ORDERS_START}' GROUP BY 1)
SELECT 'customer' AS kind, s.o_custkey, seg.label, s.total, s.n
FROM spend s JOIN customer c ON c.c_custkey = s.o_custkey
JOIN (VALUES ('AUTOMOBILE', 'wheels'), ('MACHINERY', 'works'), ('BUILDING', 'works'), ('FURNITURE', 'home'), ('HOUSEHOLD', 'home')) seg(segment, label)
  ON seg.segment = c.c_mktsegment
ORDER BY s.total DESC, s.o_custkey ASC LIMIT {TOP}
""")
def sql_text_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text over temporary views and a literal frame; a report of the first rows of a total order."""
    t = tables.ParquetTables(spark, sf_dir)
    suffix = scratch_path(spark, "v").rsplit("-", 1)[1]
    t("orders").createOrReplaceTempView(f"orders_{suffix}")
    t("customer").createOrReplaceTempView(f"customer_{suffix}")
    labels = spark.createDataFrame([("AUTOMOBILE", "wheels"), ("MACHINERY", "works"), ("BUILDING", "works"), ("FURNITURE", "home"),
                                    ("HOUSEHOLD", "home")], "segment string, label string")
    labels.createOrReplaceTempView(f"segment_{suffix}")
    spark.sql(f"""create or replace temp view spend_{suffix} as
        select o_custkey, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, count(*) as n from orders_{suffix}
        where o_orderdate >= date'{fx.ORDERS_START}' group by o_custkey""")
    out = spark.sql(f"""select o_custkey, label, total, n from spend_{suffix} join customer_{suffix} on c_custkey = o_custkey
                        join segment_{suffix} on segment = c_mktsegment""")
    return out.orderBy(F.desc("total"), F.asc("o_custkey")).limit(TOP).select(F.lit("customer").alias("kind"), "*")


# Every seventh line has a word for its key, every eleventh lacks its last field, every thirteenth has one too many.
_LINE_SQL = """CASE WHEN c_custkey % 7 = 0 THEN 'key ' || c_custkey ELSE c_custkey::VARCHAR END || ';' || c_mktsegment
  || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE ';' || c_nationkey END || CASE WHEN c_custkey % 13 = 0 THEN ';more' ELSE '' END"""


@register("csv_rejects", f"""
WITH l AS (SELECT c_custkey, c_mktsegment, c_nationkey, {_LINE_SQL} AS line,
  c_custkey % 7 = 0 OR (c_custkey % 11 = 0) <> (c_custkey % 13 = 0) OR (c_custkey % 11 = 0 AND c_custkey % 13 = 0) AS bad FROM customer)
SELECT 'good' AS part, c_mktsegment AS what, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, CAST(sum(c_nationkey) AS BIGINT) AS nations FROM l WHERE NOT bad GROUP BY ALL
UNION ALL SELECT 'rejected', line, count(*), NULL, NULL FROM l WHERE bad GROUP BY ALL
""")
def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with lines that do not parse: the good rows by segment, and every rejected line as it stood."""
    path = scratch_path(spark, "customer-csv")
    c = tables.ParquetTables(spark, sf_dir)("customer")
    key = F.col("c_custkey")
    text = F.concat(F.when(key % 7 == 0, F.concat(F.lit("key "), key)).otherwise(key.cast("string")), F.lit(";"), "c_mktsegment",
                    F.when(key % 11 == 0, "").otherwise(F.concat(F.lit(";"), "c_nationkey")), F.when(key % 13 == 0, ";more").otherwise(""))
    c.select(text).write.text(path)
    good, rejected = tables.read_csv_with_rejects(spark, path, "key long, segment string, nation int", header=False, sep=";")
    none = F.lit(None).cast("long")
    return good.groupBy(F.lit("good").alias("part"), F.col("segment").alias("what")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"), F.sum("nation").alias("nations")).unionByName(
        rejected.groupBy(F.lit("rejected").alias("part"), F.col("rejected_line").alias("what")).agg(
            F.count(F.lit(1)).alias("n"), none.alias("keys"), none.alias("nations")))


_SEGMENTS_SQL = "SELECT c_mktsegment AS segment, c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY ALL"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.ParquetTables(spark, sf_dir)("customer")
    return c.groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))


@register("managed_table_overwrite", _SEGMENTS_SQL)
def managed_table_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A managed table, written twice: the second run's rows replace the first's."""
    rows, name = _segments(spark, sf_dir), "segments_" + scratch_path(spark, "t").rsplit("-", 1)[1]
    for frame in (rows.where("nation < 5").withColumn("customers", F.lit(0).cast("long")), rows):
        sinks.write_table(frame, name)
    return tables.read_table(spark, name)


@register("path_overwrite", _SEGMENTS_SQL)
def path_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files, written twice."""
    rows, path = _segments(spark, sf_dir), scratch_path(spark, "segments")
    for frame in (rows.unionByName(rows), rows):
        sinks.write_path(frame, path)
    return tables.read_format(spark, path)


@register("literal_distinct", "SELECT DISTINCT 'orders' AS origin, 7 AS batch, DATE '2001-08-01' AS as_of, o_orderstatus FROM orders")
def literal_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal columns beside a column of the table, each combination once."""
    o = tables.ParquetTables(spark, sf_dir)("orders")
    return o.select(F.lit("orders").alias("origin"), F.lit(7).alias("batch"), F.lit(fx.ORDERS_AS_OF).cast("date").alias("as_of"), "o_orderstatus").dropDuplicates()
