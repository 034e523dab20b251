"""Business inputs derived from the driver's TPC-H-like tables.

The reference jobs read payment, subscription and cashback tables that the
driver does not provide. These functions derive frames with the same columns
and roles from ``orders``, ``lineitem``, ``part`` and ``events`` (mapping in
FIXTURES.md section 3). They are lazy DataFrame transformations, so every
registered query still scans the driver tables and grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import shift_hours
from ..operators.key_filter import with_partner
from ..operators.subscription import HISTORY_SHIFT_HOURS, PackageRules
from ..sources.tables import ParquetTables

# Reference dates of the fixtures (never current_date, so results are stable).
EVENTS_AS_OF = "2024-01-31"
EVENTS_START = "2024-01-01"
ORDERS_AS_OF = "2001-08-01"
ORDERS_START = "1995-01-01"


def events_activity(t: ParquetTables) -> DataFrame:
    """Activity base: consumer = user_id, group = event_type, day of ts."""
    return t("events").select(F.col("user_id").alias("consumer_id"),
                              F.to_date("ts").alias("created_date"), "event_type")


# --- payment transactions (orders + lineitem) --------------------------------
# installments = number of lineitems of the order; method by order status;
# type 'PJ' for priority 5, else 'PF'.

def pix_transactions(t: ParquetTables) -> DataFrame:
    items = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items"))
    o = t("orders")
    return (o.join(items, o.o_orderkey == items.l_orderkey, "left")
             .select(F.col("o_orderkey").alias("all_transaction_id"),
                     F.col("o_custkey").alias("user_id"),
                     F.col("o_orderdate").alias("adjusted_created_at"),
                     F.col("n_items").cast("string").alias("installments"),
                     F.when(F.col("o_orderstatus") == "F", "CREDIT_CARD")
                      .when(F.col("o_orderstatus") == "O", "BALANCE_AND_CREDIT_CARD")
                      .otherwise("BALANCE").alias("payment_method"),
                     F.when(F.col("o_orderpriority").startswith("5"), "PJ").otherwise("PF")
                      .alias("pix_transaction_type"),
                     F.col("o_orderstatus").alias("status"),
                     F.col("o_totalprice").alias("paid_total_value_with_revenue")))


PIX_TRANSACTIONS_SQL = """
SELECT o.o_orderkey AS all_transaction_id, o.o_custkey AS user_id, o.o_orderdate AS adjusted_created_at,
       CAST(n.n_items AS VARCHAR) AS installments,
       CASE o.o_orderstatus WHEN 'F' THEN 'CREDIT_CARD' WHEN 'O' THEN 'BALANCE_AND_CREDIT_CARD'
            ELSE 'BALANCE' END AS payment_method,
       CASE WHEN o.o_orderpriority LIKE '5%' THEN 'PJ' ELSE 'PF' END AS pix_transaction_type,
       o.o_orderstatus AS status, o.o_totalprice AS paid_total_value_with_revenue
FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY 1) n
  ON o.o_orderkey = n.l_orderkey
"""


# --- subscriptions (orders + lineitem) ---------------------------------------
# One contract per order: consumer = o_custkey, contract = o_orderkey,
# package = priority digit with a title per priority, CANCELED when status F,
# effective_at = first ship date of the order. History = one event per
# lineitem at its ship date. All orders are contracts.
SUBSCRIPTION_FROM = "1995-01-01"
POOL_BEFORE = "2001-04-01"
CHECK_DAY = "2001-06-15"
PACKAGE_TITLES = (("1", "Harbour Yearly"), ("2", "Harbour Monthly"), ("3", "Starter"), ("4", "Harbour Family"), ("5", "Trial"))
BASIC_TITLE = "Starter"
RULES = PackageRules(premium_titles=("harbour yearly", "harbour monthly", "harbour family"), original_title="starter",
                     type_order=("premium", "original"))
PORTABILITY = "Conta transferida"
HISTORY_TIE_BREAKERS = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _package_title(priority_col: str) -> F.Column:
    digit = F.substring(priority_col, 1, 1)
    expr = None
    for d, title in PACKAGE_TITLES:
        expr = F.when(digit == d, F.lit(title)) if expr is None else expr.when(digit == d, F.lit(title))
    return expr


def subscriptions(t: ParquetTables) -> DataFrame:
    o = t("orders")
    eff = t("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("effective_at"))
    return (o.join(eff, o.o_orderkey == eff.l_orderkey, "left")
             .select(F.col("o_custkey").alias("consumer_id"), F.col("o_orderkey").alias("contract_number"),
                     F.substring("o_orderpriority", 1, 1).cast("int").alias("package_id"),
                     _package_title("o_orderpriority").alias("package_title"),
                     F.when(F.col("o_orderstatus") == "F", "CANCELED").otherwise("SUBSCRIBED")
                      .alias("subscription_status"),
                     F.col("o_orderdate").alias("created_at"), "effective_at",
                     F.col("o_orderdate").alias("updated_at")))


def status_history(t: ParquetTables) -> DataFrame:
    l, o = t("lineitem"), t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    status = (F.when(F.col("l_returnflag") == "R", "CANCELED")
               .when(F.col("l_returnflag") == "A", "SUBSCRIBED")
               .when(F.col("l_linestatus") == "F", "DISCONTINUED")
               .when(F.col("l_quantity") < 10, "PRE_SUBSCRIPTION")
               .otherwise("SUBSCRIBING"))
    desc = (F.when(F.col("l_tax") == 0, F.lit(None).cast("string"))
             .when(F.col("l_discount") == 0.01, "Reaiblitado")
             .when((F.col("l_linestatus") == "O") & (F.col("l_discount") >= 0.05), "Plano REABILITADO")
             .when(F.col("l_discount") == 0.02, "reativação manual")
             .when(F.col("l_discount") == 0.03, PORTABILITY)
             .otherwise("Assinatura"))
    return (l.join(o, l.l_orderkey == o.o_orderkey, "inner")
             .select(F.col("o_custkey").alias("consumer_id"), F.col("l_orderkey").alias("contract_number"),
                     _package_title("o_orderpriority").alias("package_title"),
                     desc.alias("history_description"), status.alias("history_status"),
                     F.col("l_shipdate").alias("status_history_at"), *HISTORY_TIE_BREAKERS))


def _title_sql(col: str) -> str:
    return "CASE substr(" + col + ", 1, 1) " + " ".join(
        f"WHEN '{d}' THEN '{title}'" for d, title in PACKAGE_TITLES) + " END"


SUBSCRIPTIONS_SQL = f"""
SELECT o.o_custkey AS consumer_id, o.o_orderkey AS contract_number,
       CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS package_id,
       {_title_sql('o.o_orderpriority')} AS package_title,
       CASE WHEN o.o_orderstatus = 'F' THEN 'CANCELED' ELSE 'SUBSCRIBED' END AS subscription_status,
       o.o_orderdate AS created_at, e.effective_at, o.o_orderdate AS updated_at
FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS effective_at FROM lineitem GROUP BY 1) e
  ON o.o_orderkey = e.l_orderkey
"""

STATUS_HISTORY_SQL = f"""
SELECT o.o_custkey AS consumer_id, l.l_orderkey AS contract_number,
       {_title_sql('o.o_orderpriority')} AS package_title,
       CASE WHEN l.l_tax = 0 THEN NULL
            WHEN l.l_discount = 0.01 THEN 'Reaiblitado'
            WHEN l.l_linestatus = 'O' AND l.l_discount >= 0.05 THEN 'Plano REABILITADO'
            WHEN l.l_discount = 0.02 THEN 'reativação manual'
            WHEN l.l_discount = 0.03 THEN '{PORTABILITY}'
            ELSE 'Assinatura' END AS history_description,
       CASE WHEN l.l_returnflag = 'R' THEN 'CANCELED' WHEN l.l_returnflag = 'A' THEN 'SUBSCRIBED'
            WHEN l.l_linestatus = 'F' THEN 'DISCONTINUED' WHEN l.l_quantity < 10 THEN 'PRE_SUBSCRIPTION'
            ELSE 'SUBSCRIBING' END AS history_status,
       l.l_shipdate AS status_history_at, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""


def contract_consumer(t: ParquetTables) -> DataFrame:
    """Contract dates table: created, effective and canceled (latest status time).

    The latest status event of a contract is ordered by time first, so its
    time is the contract's maximum event time (shifted by -3 hours, in-scope
    titles only): a grouped max, no second window over the history.
    """
    last = t("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("_last"))
    s = subscriptions(t)
    canceled = ((F.col("subscription_status") == "CANCELED") & RULES.in_scope(F.col("package_title")))
    return (s.join(last, F.col("contract_number") == F.col("l_orderkey"), "left")
             .select("contract_number", "created_at", "effective_at",
                     F.when(canceled, shift_hours("_last", HISTORY_SHIFT_HOURS)).alias("canceled_at")))


# --- cashback (orders + lineitem + part) --------------------------------------
# Product by order priority: 1 PIX, 2 P2P, 3 BILLS, 4 vehicular debts,
# 5 instant cash. Ids: all_transaction_id 'A<orderkey>', transaction and core
# id 'T<orderkey>', correlation id 'C<orderkey>'. Card = o_totalprice; wallet =
# o_totalprice when status P and the key is even; fee = 2 % of the card value;
# type MULTIPLE_CARDS (lower case when the key is a multiple of 3) for status
# O, else SINGLE_CARD. Promo (legacy cashback) and legacy instant cash: every
# lineitem, so the keys of an order repeat; cashback = l_extendedprice * l_discount / 10,
# total card = l_extendedprice, campaign = l_partkey, promo date = ship date.
# Events: one per lineitem, status CREATED for line status F, else EXPIRED.
# Campaigns: part, flagged when p_brand like '%#1%'.
CASHBACK_START = "1995-01-01"
CASHBACK_END = "2001-08-15"
CASHBACK_CUT = "1998-01-01"
CASHBACK_KEY_SWITCH = "1996-07-01"
CASHBACK_CORE_MIN_YEAR = 1998
CAMPAIGN_PATTERN = "%#1%"
PROMO_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def _tenth(rate: str) -> F.Column:
    """A tenth of the line's price at the given rate, in cents."""
    return F.expr(f"cast(cast(l_extendedprice as decimal(18,2)) * cast({rate} as decimal(4,2)) * 0.1BD as decimal(18,2))")


def _ids(key: str = "o_orderkey") -> dict[str, F.Column]:
    k = F.col(key).cast("string")
    return {"all_transaction_id": F.concat(F.lit("A"), k), "transaction_id": F.concat(F.lit("T"), k),
            "correlation_id": F.concat(F.lit("C"), k)}


def _payment_values() -> dict[str, F.Column]:
    price, status, key = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderstatus"), F.col("o_orderkey")
    return {
        "card": price,
        "wallet": F.when((status == "P") & (key % 2 == 0), price).otherwise(F.lit(0).cast("decimal(18,2)")),
        "fee": (price * F.expr("0.02BD")).cast("decimal(18,2)"),
        "type": F.when((status == "O") & (key % 3 == 0), F.lit("multiple_cards"))
                 .when(status == "O", F.lit("MULTIPLE_CARDS")).otherwise(F.lit("SINGLE_CARD")),
        "card_id": F.col("o_custkey") % 97,
        "installments": key % 12 + 1,
    }


BUSINESS_SEGMENT = "MACHINERY"


def _orders_of(t: ParquetTables, digit: str, with_segment: bool = False) -> DataFrame:
    o = t("orders").where(F.substring("o_orderpriority", 1, 1) == digit)
    if not with_segment:
        return o
    c = t("customer").select(F.col("c_custkey"), (F.col("c_mktsegment") == BUSINESS_SEGMENT).alias("_business"))
    return o.join(c, o.o_custkey == c.c_custkey, "left")


def cashback_payment_tables(t: ParquetTables) -> dict[str, DataFrame]:
    v, ids = _payment_values(), _ids()
    pix = _orders_of(t, "1", with_segment=True).select(
        F.to_date("o_orderdate").alias("adjusted_created_date"),
        F.when(F.col("_business"), "BUSINESS").otherwise("CONSUMER").alias("user_type"),
        v["card"].alias("paid_card_value"), v["wallet"].alias("paid_wallet_value"),
        v["fee"].alias("payment_total_fee"), v["type"].alias("transaction_type"),
        ids["transaction_id"].alias("transactional_core_id"), ids["all_transaction_id"].alias("all_transaction_id"),
        ids["correlation_id"].alias("correlation_id"), v["card_id"].alias("credit_card_id"),
        F.col("o_custkey").alias("consumer_id"), v["installments"].alias("installments"))
    p2p = _orders_of(t, "2", with_segment=True).select(
        F.col("o_orderdate").alias("created_at"), F.coalesce(F.col("_business"), F.lit(False)).alias("is_business_transaction"),
        v["card"].alias("paid_card_value"), v["wallet"].alias("paid_wallet_value"), v["fee"].alias("total_revenue"),
        v["type"].alias("transaction_type"), F.col("o_custkey").alias("payer_id"),
        *[c.alias(n) for n, c in ids.items()], v["card_id"].alias("credit_card_id"),
        v["installments"].alias("installments"))
    bills = _orders_of(t, "3").select(
        F.col("o_orderdate").alias("created_at"), v["card"].alias("paid_credit_card_value"),
        v["wallet"].alias("paid_balance_value"), v["fee"].alias("total_revenue"), v["type"].alias("payment_type"),
        *[c.alias(n) for n, c in ids.items()], v["card_id"].alias("credit_card_id"),
        v["installments"].alias("installments"))
    vehicular = _orders_of(t, "4").select(
        F.col("o_orderdate").alias("created_at"), v["card"].alias("paid_card_value"),
        v["wallet"].alias("paid_wallet_value"), v["fee"].alias("total_revenue"), v["type"].alias("payment_type"),
        F.concat(F.lit("DEBT_"), F.col("o_orderstatus")).alias("transaction_type"),
        F.col("o_custkey").alias("consumer_id"), *[c.alias(n) for n, c in ids.items()],
        v["card_id"].alias("credit_card_id"), v["installments"].alias("installments"))
    return {"PIX": pix, "P2P": p2p, "BILLS": bills, "Multas e IPVA": vehicular}


def _lines(t: ParquetTables) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "inner")


def promo_transactions(t: ParquetTables) -> DataFrame:
    f = _lines(t).where(~F.col("o_orderpriority").startswith("5"))
    ids = _ids("l_orderkey")
    return f.select(
        F.col("l_shipdate").alias("created_at"),
        F.concat(F.lit("P"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("promo_transaction_id"),
        F.col("l_partkey").alias("campaign_id"), ids["all_transaction_id"].alias("all_transaction_id"),
        ids["transaction_id"].alias("transaction_id"), F.col("o_custkey").alias("consumer_id"),
        _tenth("l_discount").alias("received_cashback_value"),
        F.col("l_extendedprice").alias("paid_credit_card_value"))


def instant_cash(t: ParquetTables) -> DataFrame:
    # a fifth of the lines: the others are taken out before the exchange
    o = t("orders").where(F.col("o_orderpriority").startswith("5")).select("o_orderkey", "o_custkey", "o_orderdate")
    f = with_partner(t("lineitem"), ["l_orderkey"], o, ["o_orderkey"]).join(o, F.col("l_orderkey") == F.col("o_orderkey"), "inner")
    return f.select(F.col("l_partkey").alias("campaign_id"), F.col("o_custkey").alias("consumer_id"),
                    F.col("o_orderdate").alias("created_at"),
                    _tenth("l_discount").alias("instant_cash_given_value"))


def campaign_taxonomy(t: ParquetTables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("promo_campaign_id"), F.col("p_brand").alias("bu_solicitante"),
                            F.concat(F.lit("B"), F.col("p_size").cast("string")).alias("briefing_id"),
                            (F.col("p_size").cast("double") / 100).alias("cashback_percentage"))


def cashback_events(t: ParquetTables) -> DataFrame:
    l = t("lineitem")
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_orderpriority").startswith("5").alias("_instant"))
    j = l.join(o, l.l_orderkey == o.o_orderkey, "inner")
    code = (F.when(F.col("_instant"), F.lit(INSTANT_CODE))
             .when(F.col("l_linenumber") == 7, F.lit(None).cast("int"))
             .otherwise(F.col("l_linenumber")))
    return j.select(
        F.concat_ws("-", F.lit("E"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string")).alias("id"),
        F.col("o_custkey").alias("user_id"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("properties_movement_id"),
        F.when(F.col("l_linestatus") == "F", "CREATED").otherwise("EXPIRED").alias("properties_status"),
        F.col("o_orderdate").alias("properties_created_at"), code.cast("int").alias("properties_wallet_code_id"),
        F.col("l_partkey").alias("properties_promo_campaign_id"),
        F.concat(F.lit("C"), F.col("l_orderkey").cast("string")).alias("properties_origin_transaction_id"),
        _tenth("l_discount").alias("properties_original_amount"),
        _tenth("l_tax").alias("properties_returned_amount"),
        *PROMO_ORDER)


INSTANT_CODE = 419


def core_transactions(t: ParquetTables) -> DataFrame:
    return t("orders").select(F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("correlation_id"),
                              F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("base_value"))
