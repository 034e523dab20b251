"""Registered queries: cashback payments.

The DuckDB twin is written branch by branch (one SELECT per product and era,
as a hand-written job would be), independently of the union-then-join plan of
the Spark operators.
"""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import surrogate_key, value_bucket_sql
from ..operators import cashback
from ..operators.ids import count_marks
from ..session import scratch_path
from ..sources.tables import ParquetTables
from ..streaming.dedupe_state import DedupeState
from . import fixtures as fx
from .catalog import register

PARAMS = cashback.CashbackParams(
    start=fx.CASHBACK_START, end=fx.CASHBACK_END, cut=fx.CASHBACK_CUT, key_switch=fx.CASHBACK_KEY_SWITCH,
    flag_pattern=fx.CAMPAIGN_PATTERN, as_of=fx.CASHBACK_END, core_min_year=fx.CASHBACK_CORE_MIN_YEAR)

S, E, CUT, SW = (f"DATE '{fx.CASHBACK_START}'", f"DATE '{fx.CASHBACK_END}'", f"DATE '{fx.CASHBACK_CUT}'",
                 f"DATE '{fx.CASHBACK_KEY_SWITCH}'")


def _ids(k: str) -> str:
    return (f"'A' || CAST({k} AS VARCHAR) AS all_transaction_id, 'T' || CAST({k} AS VARCHAR) AS transaction_id, "
            f"'C' || CAST({k} AS VARCHAR) AS correlation_id")


SOURCES_SQL = f"""
WITH pay_base AS (
  SELECT o.*, substr(o_orderpriority, 1, 1) AS pdig, o_totalprice::DECIMAL(18,2) AS card,
         CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN o_totalprice::DECIMAL(18,2) ELSE 0 END AS wallet,
         (o_totalprice::DECIMAL(18,2) * 0.02)::DECIMAL(18,2) AS fee,
         CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'multiple_cards'
              WHEN o_orderstatus = 'O' THEN 'MULTIPLE_CARDS' ELSE 'SINGLE_CARD' END AS ttype,
         o_custkey % 97 AS card_id, o_orderkey % 12 + 1 AS inst, {_ids('o_orderkey')},
         c.c_mktsegment = '{fx.BUSINESS_SEGMENT}' AS business
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
pix AS (SELECT CAST(o_orderdate AS DATE) AS adjusted_created_date,
               CASE WHEN business THEN 'BUSINESS' ELSE 'CONSUMER' END AS user_type,
               card AS paid_card_value, wallet AS paid_wallet_value, fee AS payment_total_fee,
               ttype AS transaction_type, transaction_id AS transactional_core_id, all_transaction_id,
               correlation_id, card_id AS credit_card_id, o_custkey AS consumer_id, inst AS installments
        FROM pay_base WHERE pdig = '1'),
p2p AS (SELECT o_orderdate AS created_at, COALESCE(business, FALSE) AS is_business_transaction,
               card AS paid_card_value, wallet AS paid_wallet_value, fee AS total_revenue,
               ttype AS transaction_type, o_custkey AS payer_id, all_transaction_id, transaction_id,
               correlation_id, card_id AS credit_card_id, inst AS installments
        FROM pay_base WHERE pdig = '2'),
bills AS (SELECT o_orderdate AS created_at, card AS paid_credit_card_value, wallet AS paid_balance_value,
                 fee AS total_revenue, ttype AS payment_type, all_transaction_id, transaction_id,
                 correlation_id, card_id AS credit_card_id, inst AS installments
          FROM pay_base WHERE pdig = '3'),
veh AS (SELECT o_orderdate AS created_at, card AS paid_card_value, wallet AS paid_wallet_value,
               fee AS total_revenue, ttype AS payment_type, 'DEBT_' || o_orderstatus AS transaction_type,
               o_custkey AS consumer_id, all_transaction_id, transaction_id, correlation_id,
               card_id AS credit_card_id, inst AS installments
        FROM pay_base WHERE pdig = '4'),
line AS (
  SELECT l.*, o.o_custkey, o.o_orderdate, o.o_orderpriority
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
promo AS (SELECT l_shipdate AS created_at,
                 'P' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS promo_transaction_id,
                 l_partkey AS campaign_id, 'A' || CAST(l_orderkey AS VARCHAR) AS all_transaction_id,
                 'T' || CAST(l_orderkey AS VARCHAR) AS transaction_id, o_custkey AS consumer_id,
                 (l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2) * 0.1)::DECIMAL(18,2) AS received_cashback_value,
                 l_extendedprice::DECIMAL(18,2) AS paid_credit_card_value
          FROM line WHERE o_orderpriority NOT LIKE '5%'),
instant AS (SELECT l_partkey AS campaign_id, o_custkey AS consumer_id, o_orderdate AS created_at,
                   (l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2) * 0.1)::DECIMAL(18,2) AS instant_cash_given_value
            FROM line WHERE o_orderpriority LIKE '5%'),
tax AS (SELECT p_partkey AS promo_campaign_id, p_brand AS bu_solicitante, 'B' || CAST(p_size AS VARCHAR) AS briefing_id,
               CAST(p_size AS DOUBLE) / 100 AS cashback_percentage FROM part),
events AS (
  SELECT concat_ws('-', 'E', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR),
                   CAST(l.l_partkey AS VARCHAR)) AS id,
         o.o_custkey AS user_id, l.l_orderkey * 16 + l.l_linenumber AS properties_movement_id,
         CASE WHEN l.l_linestatus = 'F' THEN 'CREATED' ELSE 'EXPIRED' END AS properties_status,
         o.o_orderdate AS properties_created_at,
         CASE WHEN o.o_orderpriority LIKE '5%' THEN 419 WHEN l.l_linenumber = 7 THEN NULL
              ELSE l.l_linenumber END AS properties_wallet_code_id,
         l.l_partkey AS properties_promo_campaign_id,
         'C' || CAST(l.l_orderkey AS VARCHAR) AS properties_origin_transaction_id,
         (l.l_extendedprice::DECIMAL(18,2) * l.l_discount::DECIMAL(4,2) * 0.1)::DECIMAL(18,2) AS properties_original_amount,
         (l.l_extendedprice::DECIMAL(18,2) * l.l_tax::DECIMAL(4,2) * 0.1)::DECIMAL(18,2) AS properties_returned_amount,
         l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
core AS (SELECT 'C' || CAST(o_orderkey AS VARCHAR) AS correlation_id, o_orderdate AS created_at,
                o_totalprice::DECIMAL(18,2) AS base_value FROM orders),
camp AS (
  SELECT promo_campaign_id AS campaign_id, briefing_id, cashback_percentage, TRUE AS is_flagged_campaign
  FROM tax WHERE bu_solicitante LIKE '{fx.CAMPAIGN_PATTERN}'
  QUALIFY row_number() OVER (PARTITION BY promo_campaign_id
                             ORDER BY briefing_id NULLS FIRST, cashback_percentage NULLS FIRST) = 1),
promo_cb AS (
  SELECT CASE WHEN CAST(p.created_at AS DATE) >= {SW} THEN p.transaction_id ELSE p.all_transaction_id END
           AS pix_id_cashback,
         p.promo_transaction_id, p.campaign_id, p.all_transaction_id, p.transaction_id, p.consumer_id,
         p.received_cashback_value AS received_cashback_value_promo,
         p.paid_credit_card_value AS paid_credit_card_value_promo,
         c.briefing_id, c.cashback_percentage, COALESCE(c.is_flagged_campaign, FALSE) AS is_flagged_campaign
  FROM promo p LEFT JOIN camp c ON p.campaign_id = c.campaign_id
  WHERE CAST(p.created_at AS DATE) BETWEEN {S} AND {E}),
ev_cb AS (
  SELECT e.id AS cleaned_event_cashback_status_changed_id,
         COALESCE(c.is_flagged_campaign, FALSE) AS is_flagged_campaign, e.properties_status,
         CAST(e.properties_created_at AS DATE) AS created_date_cashback,
         COALESCE(e.properties_wallet_code_id = 419, FALSE) AS is_instant_cash,
         e.properties_movement_id, c.briefing_id, c.cashback_percentage,
         e.properties_origin_transaction_id AS correlation_id, e.properties_promo_campaign_id AS campaign_id,
         e.user_id AS consumer_id,
         CASE WHEN e.properties_status = 'CREATED' THEN e.properties_original_amount ELSE 0 END AS cashback_pago,
         CASE WHEN e.properties_status = 'EXPIRED' THEN e.properties_returned_amount ELSE 0 END AS cashback_raspado,
         CASE WHEN e.properties_status = 'CREATED' THEN k.base_value ELSE 0 END AS paid_credit_card_value_promo
  FROM (SELECT * FROM events
        QUALIFY row_number() OVER (PARTITION BY properties_movement_id, properties_status
                                   ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) = 1) e
  LEFT JOIN camp c ON e.properties_promo_campaign_id = c.campaign_id
  JOIN (SELECT correlation_id, base_value FROM core
        WHERE year(created_at) >= {fx.CASHBACK_CORE_MIN_YEAR}
          AND CAST(created_at AS DATE) BETWEEN {S} AND {E}) k
    ON e.properties_origin_transaction_id = k.correlation_id
  WHERE CAST(e.properties_created_at AS DATE) BETWEEN {S} AND {E}
    AND CAST(e.properties_created_at AS DATE) >= {CUT} AND e.properties_status = 'CREATED')
"""


def _alloc(w, card, typ, cb, fee, total):
    """The share in whole cents, by integers: rounded half up at six places, then at two, as decimals are."""
    cents = lambda x: f"(COALESCE({x}, 0) * 100)::HUGEINT"
    over, under = f"{cents(cb)} * ({cents(card)} - {cents(fee)}) * 10000", cents(total)
    six = f"((2 * {over} + {under}) // (2 * {under}))"
    shared = f"CASE WHEN {under} <> 0 AND {cb} IS NOT NULL THEN ((({six} + 5000) // 10000)::DECIMAL(18,2) * 0.01)::DECIMAL(18,2) END"
    return (f"CASE WHEN {w} > 0 THEN 0 "
            f"WHEN {card} > 0 AND upper({typ}) <> 'MULTIPLE_CARDS' THEN COALESCE({cb}, 0) "
            f"WHEN {card} > 0 AND upper({typ}) = 'MULTIPLE_CARDS' THEN {shared} ELSE 0 END")


COLUMNS = [(f.name, {"StringType()": "VARCHAR", "DoubleType()": "DOUBLE", "LongType()": "BIGINT",
                     "DateType()": "DATE", "BooleanType()": "BOOLEAN", "DecimalType(18,2)": "DECIMAL(18,2)"}[repr(f.dataType)])
           for f in cashback.BRANCH_SCHEMA.fields]


def _select(values: dict[str, str]) -> str:
    return ", ".join(f"CAST({values.get(n, 'NULL')} AS {t}) AS {n}" for n, t in COLUMNS)


# (table, name, date expr, fee, wallet, card, type tested, type out, consumer or None, key kind, pre-filter)
PRODUCT_SQL = [
    ("pix", "PIX", "p.adjusted_created_date", "p.payment_total_fee", "p.paid_wallet_value", "p.paid_card_value",
     "p.transaction_type", "p.transaction_type", "p.consumer_id", "era", "p.user_type = 'CONSUMER'"),
    ("p2p", "P2P", "CAST(p.created_at AS DATE)", "p.total_revenue", "p.paid_wallet_value", "p.paid_card_value",
     "p.transaction_type", "p.transaction_type", "p.payer_id", "all", "p.is_business_transaction = FALSE"),
    ("bills", "BILLS", "CAST(p.created_at AS DATE)", "p.total_revenue", "p.paid_balance_value",
     "p.paid_credit_card_value", "p.payment_type", "p.payment_type", None, "all", "TRUE"),
    ("veh", "Multas e IPVA", "CAST(p.created_at AS DATE)", "p.total_revenue", "p.paid_wallet_value",
     "p.paid_card_value", "p.payment_type", "p.transaction_type", "p.consumer_id", "all", "TRUE"),
]


def _product_branches(era: str) -> list[str]:
    out = []
    for tab, name, d, fee, w, card, typ, tout, cons, kind, pre in PRODUCT_SQL:
        base_where = f"{d} BETWEEN {S} AND {E} AND {card} > 0 AND {pre}"
        core = "p.transactional_core_id" if tab == "pix" else "NULL"
        common = {"all_transaction_id": "p.all_transaction_id", "product_type_name": f"'{name}'",
                  "type": "'cashback'", "briefing_id": "c.briefing_id",
                  "cashback_percentage": "c.cashback_percentage", "campaign_id": "c.campaign_id",
                  "transactional_core_id": core, "correlation_id": "p.correlation_id", "created_date": d,
                  "is_mtd": f"COALESCE(day({d}) <= day({E}), FALSE)", "is_flagged_campaign": "c.is_flagged_campaign",
                  "credit_card_id": "p.credit_card_id", "installments": "p.installments",
                  "transaction_type": tout, "paid_card_value": card, "total_revenue": fee}
        if era == "before":
            value = _alloc(w, card, typ, "c.received_cashback_value_promo", fee, "c.paid_credit_card_value_promo")
            key = (f"CASE WHEN {d} >= {SW} THEN p.transactional_core_id ELSE p.all_transaction_id END = c.pix_id_cashback"
                   if kind == "era" else "p.all_transaction_id = c.all_transaction_id")
            common.update(promo_transaction_id="c.promo_transaction_id",
                          transaction_id="c.transaction_id" if tab == "pix" else "p.transaction_id",
                          consumer_id=cons or "c.consumer_id")
            src, where = f"{tab} p JOIN promo_cb c ON {key}", f"{base_where} AND {d} < {CUT}"
        else:
            value = _alloc(w, card, typ, "c.cashback_pago", fee, "c.paid_credit_card_value_promo")
            common.update(cleaned_event_cashback_status_changed_id="c.cleaned_event_cashback_status_changed_id",
                          transaction_id="NULL" if tab == "pix" else "p.transaction_id",
                          consumer_id=cons or "c.consumer_id")
            src = f"{tab} p JOIN (SELECT * FROM ev_cb WHERE NOT is_instant_cash) c ON p.correlation_id = c.correlation_id"
            where = f"{base_where} AND {d} >= {CUT}"
        common.update(cashback_value=value, cashback_range=value_bucket_sql(f"({value})"))
        out.append(f"SELECT {_select(common)} FROM {src} WHERE {where}")
    return out


_INSTANT_BEFORE = "SELECT " + _select({
    "product_type_name": "'Instant Cash'", "type": "'instant_cash'", "briefing_id": "c.briefing_id",
    "cashback_percentage": "c.cashback_percentage", "campaign_id": "i.campaign_id",
    "created_date": "CAST(i.created_at AS DATE)", "is_mtd": f"COALESCE(day(i.created_at) <= day({E}), FALSE)",
    "is_flagged_campaign": "COALESCE(c.is_flagged_campaign, FALSE)", "consumer_id": "i.consumer_id",
    "cashback_value": "i.instant_cash_given_value", "paid_card_value": "0",
    "cashback_range": value_bucket_sql("i.instant_cash_given_value")}) + (
    f" FROM instant i JOIN camp c ON i.campaign_id = c.campaign_id"
    f" WHERE CAST(i.created_at AS DATE) BETWEEN {S} AND {E} AND CAST(i.created_at AS DATE) < {CUT}")

_INSTANT_AFTER = "SELECT " + _select({
    "cleaned_event_cashback_status_changed_id": "cleaned_event_cashback_status_changed_id",
    "product_type_name": "'Instant Cash'", "type": "'instant_cash'", "briefing_id": "briefing_id",
    "cashback_percentage": "cashback_percentage", "campaign_id": "campaign_id", "correlation_id": "correlation_id",
    "created_date": "created_date_cashback", "is_mtd": f"COALESCE(day(created_date_cashback) <= day({E}), FALSE)",
    "is_flagged_campaign": "is_flagged_campaign", "consumer_id": "consumer_id", "cashback_value": "cashback_pago",
    "cashback_range": value_bucket_sql("cashback_pago")}) + " FROM ev_cb WHERE is_instant_cash AND is_flagged_campaign"

BEFORE_SQL = " UNION ALL ".join(_product_branches("before") + [_INSTANT_BEFORE])
AFTER_SQL = " UNION ALL ".join(_product_branches("after") + [_INSTANT_AFTER])

FACT_SQL = f"""
SELECT cleaned_event_cashback_status_changed_id, promo_transaction_id, campaign_id, briefing_id,
       transactional_core_id, transaction_id, correlation_id, credit_card_id, all_transaction_id, consumer_id,
       created_date, strftime(created_date, '%Y-%m') AS year_month, type, product_type_name, transaction_type,
       is_mtd, is_flagged_campaign, installments, cashback_percentage, cashback_range,
       cashback_value AS received_cashback_value, paid_card_value AS paid_credit_card_value, total_revenue,
       strftime(created_date, '%Y') AS year_partition, strftime(created_date, '%m') AS month_partition,
       strftime(created_date, '%d') AS day_partition
FROM ({BEFORE_SQL} UNION ALL {AFTER_SQL}) u
"""


def _sources(spark: SparkSession, sf_dir: str, instant: bool = False):
    """The source frames; ``instant`` cash, whose key filter is a job of its own, for the queries that read it."""
    t = ParquetTables(spark, sf_dir)
    src = dict(payment_tables=fx.cashback_payment_tables(t), promo=fx.promo_transactions(t),
               taxonomy=fx.campaign_taxonomy(t), events=fx.cashback_events(t), core=fx.core_transactions(t))
    return {**src, "instant": fx.instant_cash(t)} if instant else src


def _report(df: DataFrame) -> DataFrame:
    """Money as double, for the report only; everything before is decimal."""
    return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema.fields if f.dataType.typeName() == "decimal"})


_MONEY = "REPLACE (cashback_value::DOUBLE AS cashback_value, paid_card_value::DOUBLE AS paid_card_value, total_revenue::DOUBLE AS total_revenue)"


def _campaigns(src):
    return cashback.sent_campaigns(cashback.flagged_campaigns(src["taxonomy"], PARAMS.flag_pattern))


def _events_cb(src):
    return cashback.status_events(src["events"], _campaigns(src), src["core"], PARAMS, list(fx.PROMO_ORDER))


@register("campaign_flag", SOURCES_SQL + "SELECT * REPLACE (received_cashback_value_promo::DOUBLE AS received_cashback_value_promo, "
          "paid_credit_card_value_promo::DOUBLE AS paid_credit_card_value_promo) FROM promo_cb")
def campaign_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _sources(spark, sf_dir)
    return _report(cashback.promo_cashback(src["promo"], _campaigns(src), PARAMS))


@register("cashback_status_base", SOURCES_SQL + "SELECT * REPLACE (cashback_pago::DOUBLE AS cashback_pago, cashback_raspado::DOUBLE AS cashback_raspado, "
          "paid_credit_card_value_promo::DOUBLE AS paid_credit_card_value_promo) FROM ev_cb")
def cashback_status_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(_events_cb(_sources(spark, sf_dir)))


@register("campaign_flag_hot", SOURCES_SQL + f"""
, hot AS (SELECT * REPLACE (CASE WHEN consumer_id % 3 = 0 THEN (SELECT min(campaign_id) FROM camp) ELSE campaign_id END AS campaign_id) FROM promo
          WHERE CAST(created_at AS DATE) BETWEEN {S} AND {E})
SELECT h.campaign_id, coalesce(c.is_flagged_campaign, FALSE) AS is_flagged_campaign, c.briefing_id, count(*) AS n_rows,
       CAST(sum(CAST(h.received_cashback_value * 100 AS BIGINT)) AS BIGINT) AS cents
FROM hot h LEFT JOIN camp c ON h.campaign_id = c.campaign_id GROUP BY ALL
""")
def campaign_flag_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags where one flagged campaign has a third of all promo rows: its rows are salted."""
    src = _sources(spark, sf_dir)
    campaigns = cashback.flagged_campaigns(src["taxonomy"], PARAMS.flag_pattern)     # salted, not sent
    least = campaigns.agg(F.min("campaign_id")).scalar()
    promo = src["promo"].withColumn("campaign_id", F.when(F.col("consumer_id") % 3 == 0, least).otherwise(F.col("campaign_id")))
    flagged = cashback.promo_cashback(promo, campaigns, dataclasses.replace(PARAMS, hot_share=0.01))
    return flagged.groupBy("campaign_id", "is_flagged_campaign", "briefing_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum((F.col("received_cashback_value_promo") * 100).cast("long")).alias("cents"))


# Loads of the events by the day on which they arrive; a movement's duplicates come in any of them.
_ARRIVALS = (None, "1997-01-01", "1999-06-01", None)


@register("cashback_status_loads", SOURCES_SQL + "SELECT * REPLACE (cashback_pago::DOUBLE AS cashback_pago, cashback_raspado::DOUBLE AS cashback_raspado, "
          "paid_credit_card_value_promo::DOUBLE AS paid_credit_card_value_promo) FROM ev_cb")
def cashback_status_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status base from three loads, each deduplicated against the state of the ones before: the rows of one dedupe of everything."""
    src = _sources(spark, sf_dir)
    state = DedupeState(scratch_path(spark, "seen-events"), cashback.EVENT_KEY, fx.PROMO_ORDER, "l_shipdate", buckets=16)
    day, kept, beaten = F.to_date("l_shipdate"), [], []
    for first, end in zip(_ARRIVALS, _ARRIVALS[1:]):
        window = src["events"].where(F.col("properties_status") == cashback.STATUS_CREATED)
        if first:
            window = window.where(day >= F.lit(first).cast("date"))
        window = window.where(day < F.lit(end).cast("date")) if end else window
        survivors, displaced = state.run(window)
        kept.append(survivors)
        beaten.append(displaced)
    union = lambda frames: functools.reduce(DataFrame.unionByName, frames)
    # a displaced row is of an earlier load and beaten for good: one anti join a load, by what the later ones beat
    rows = union([state.without(k, union(beaten[i:])) if beaten[i:] else k for i, k in enumerate(kept, 1)])
    return _report(cashback.status_events(rows, _campaigns(src), src["core"], PARAMS, deduped=True))


@register("cashback_before", SOURCES_SQL + f"SELECT * {_MONEY} FROM ({BEFORE_SQL})")
def cashback_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _sources(spark, sf_dir, instant=True)
    campaigns = _campaigns(src)
    pays = cashback.all_payments(src["payment_tables"], PARAMS)
    return _report(cashback.cashback_before(pays, cashback.promo_cashback(src["promo"], campaigns, PARAMS), PARAMS).unionByName(
        cashback.instant_cash_before(src["instant"], campaigns, PARAMS)))


@register("cashback_after", SOURCES_SQL + f"SELECT * {_MONEY} FROM ({AFTER_SQL})")
def cashback_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _sources(spark, sf_dir)
    ev = _events_cb(src)
    pays = cashback.all_payments(src["payment_tables"], PARAMS)
    return _report(cashback.cashback_after(pays, ev, PARAMS).unionByName(cashback.instant_cash_after(ev, PARAMS)))


def cashback_fact(spark: SparkSession, sf_dir: str, id_mode: str | None = "hash") -> DataFrame:
    src = _sources(spark, sf_dir, instant=True)
    branches = cashback.cashback_branches(src["payment_tables"], src["promo"], src["taxonomy"], src["instant"],
                                          src["events"], src["core"], PARAMS, list(fx.PROMO_ORDER))
    return cashback.cashback_payments(branches, id_mode=id_mode)


@register("cashback_payment_ids", SOURCES_SQL + f"""
SELECT count(*) AS n_rows, count(*) AS distinct_ids,
       count(*) > count(DISTINCT (product_type_name, type, all_transaction_id, promo_transaction_id,
             cleaned_event_cashback_status_changed_id, campaign_id, consumer_id, created_date)) AS keys_repeat
FROM ({FACT_SQL}) f
""")
def cashback_payment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact with its id: as many ids as rows, although natural keys repeat."""
    fact = cashback_fact(spark, sf_dir)
    # ids and keys as 16 bytes: the distinct counts exchange a hash of each, beside no other column
    marks = fact.select(F.unhex("cashback_payment_id").alias("ident"), F.unhex(surrogate_key(*cashback.NATURAL_KEY)).alias("key"))
    counted = count_marks(marks, "n_rows", {"ident": "distinct_ids", "key": "keys"})
    return counted.select("n_rows", "distinct_ids", (F.col("n_rows") > F.col("keys")).alias("keys_repeat"))


def _field(c: str) -> str:
    return f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _mark(fields) -> str:
    return "substr(sha256(concat_ws('|', " + ", ".join(map(_field, fields)) + ")), 1, 32)"


_MONEY_COLUMNS = ("received_cashback_value", "paid_credit_card_value", "total_revenue")
_FACT_COLUMNS = ("cleaned_event_cashback_status_changed_id", "promo_transaction_id", "campaign_id", "briefing_id", "transactional_core_id",
                 "transaction_id", "correlation_id", "credit_card_id", "all_transaction_id", "consumer_id", "created_date", "year_month", "type",
                 "product_type_name", "transaction_type", "is_mtd", "is_flagged_campaign", "installments", "cashback_percentage", "cashback_range",
                 *_MONEY_COLUMNS, "year_partition", "month_partition", "day_partition")


@register("cashback_fact_ids", SOURCES_SQL + f"""
SELECT {_mark((*cashback.NATURAL_KEY, "mark", "number"))} AS cashback_payment_id, product_type_name, type, all_transaction_id, consumer_id, created_date
FROM (SELECT *, row_number() OVER (PARTITION BY mark) AS number FROM (SELECT *, {_mark(_FACT_COLUMNS)} AS mark FROM (
  SELECT * REPLACE ({", ".join(f"{c}::DECIMAL(18,2) AS {c}" for c in _MONEY_COLUMNS)}) FROM ({FACT_SQL}))))
""")
def cashback_fact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of every row of the fact, beside some columns of its key."""
    return cashback_fact(spark, sf_dir).select("cashback_payment_id", "product_type_name", "type", "all_transaction_id", "consumer_id", "created_date")


@register("cashback_payments", SOURCES_SQL + f"""SELECT * REPLACE (received_cashback_value::DOUBLE AS received_cashback_value,
  paid_credit_card_value::DOUBLE AS paid_credit_card_value, total_revenue::DOUBLE AS total_revenue) FROM ({FACT_SQL})""")
def cashback_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(cashback_fact(spark, sf_dir, id_mode=None))
