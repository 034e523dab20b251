"""Cashback payments fact: pro-rata cashback per payment, unified over products.

Two eras split at ``cut``: before it, cashback comes from promo transactions
(joined per product on an id that may depend on the payment date); from it
on, from status-change events (CREATED), joined on ``correlation_id``. Instant
cash comes from its own table before the cut and from events (wallet code
419) after it.

Plan shape. Every product's payment table is first normalised to the same
columns by a ``ProductSpec`` (filters, column roles) and the products are
unioned. Each era then needs ONE join: the legacy era against the promo
frame, keyed by ``(key_kind, key)`` so that the product whose key changes with
the date and the products keyed by ``all_transaction_id`` share one shuffle;
the new era against the events frame on ``correlation_id``. The shared promo
and event frames are therefore scanned and shuffled once, not once per
product. Campaigns are a dimension (one row per campaign) joined by key; the
join strategy is left to AQE.

The grain is payment x cashback row: repeated keys on either side fan out, as
in the reference; ``key_fanout`` reports such keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (BooleanType, DateType, DecimalType, DoubleType, LongType, StringType, StructField,
                               StructType)

from ..functions.columns import allocate_cashback, value_bucket
from ..functions.dates import DateLike, date_lit, mtd_flag
from .ids import numbered_key
from .key_filter import with_partner
from .rank import top_per_group
from .skew import salted_join

# --- fixed values (must equal the reference's for equal results) -------------
INSTANT_WALLET_CODE = 419
STATUS_CREATED, STATUS_EXPIRED = "CREATED", "EXPIRED"
TYPE_CASHBACK, TYPE_INSTANT = "cashback", "instant_cash"
INSTANT_PRODUCT = "Instant Cash"
PRODUCT_NAMES = ("PIX", "P2P", "BILLS", "Multas e IPVA")
CONSUMER_USER_TYPE = "CONSUMER"
# -----------------------------------------------------------------------------

# Money keeps its cents: sums of doubles drift, sums of decimals do not.
MONEY = DecimalType(18, 2)

#: Flagged campaigns, some 70 bytes each, that are sent to every task; more are joined by an exchange.
CAMPAIGN_ROWS = 2_000_000

# Output schema of the unified fact before id and partition columns.
BRANCH_SCHEMA = StructType([
    StructField("all_transaction_id", StringType()),
    StructField("cleaned_event_cashback_status_changed_id", StringType()),
    StructField("product_type_name", StringType()),
    StructField("type", StringType()),
    StructField("briefing_id", StringType()),
    StructField("cashback_percentage", DoubleType()),
    StructField("promo_transaction_id", StringType()),
    StructField("campaign_id", LongType()),
    StructField("transactional_core_id", StringType()),
    StructField("transaction_id", StringType()),
    StructField("correlation_id", StringType()),
    StructField("created_date", DateType()),
    StructField("is_mtd", BooleanType()),
    StructField("is_flagged_campaign", BooleanType()),
    StructField("credit_card_id", LongType()),
    StructField("consumer_id", LongType()),
    StructField("installments", LongType()),
    StructField("transaction_type", StringType()),
    StructField("cashback_value", MONEY),
    StructField("paid_card_value", MONEY),
    StructField("total_revenue", MONEY),
    StructField("cashback_range", StringType()),
])


@dataclass(frozen=True)
class CashbackParams:
    """Dates and rules of one run.

    ``start``/``end``: analysis window (inclusive) on every source; ``cut``:
    first day of the event era; ``key_switch``: from this date the legacy
    join id is the core/transaction id instead of ``all_transaction_id``;
    ``as_of``: reference day of the month-to-date flag; ``core_min_year``:
    year bound on core transactions; ``instant_value``: event column used as
    the instant-cash value after the cut (``cashback_raspado`` reproduces the
    reference literally: always 0, since only CREATED events are kept);
    ``instant_until``: legacy instant cash is kept before this date
    (``None`` = no bound). ``join_start``: first day read of the promo, core
    and event sides (default ``start``); an incremental run that rewrites late
    days sets it to the full load's start, so pairs across the edge of the
    window are not lost. ``hot_share``: campaigns above this share of the rows
    are found first and salted in the joins with the campaigns (default: their
    skew is left to adaptive execution).
    """

    start: DateLike
    end: DateLike
    cut: DateLike
    key_switch: DateLike
    flag_pattern: str
    as_of: DateLike = None
    core_min_year: int | None = None
    instant_value: str = "cashback_pago"
    instant_until: DateLike | str | None = "cut"
    join_start: DateLike | None = None
    hot_share: float | None = None

    def in_join_window(self, d: Column) -> Column:
        return (d >= date_lit(self.start if self.join_start is None else self.join_start)) & (d <= date_lit(self.end))

    def in_window(self, d: Column) -> Column:
        return (d >= date_lit(self.start)) & (d <= date_lit(self.end))


@dataclass(frozen=True)
class ProductSpec:
    """Column roles of one payment product table.

    ``date_col`` is a date (``date_is_ts=False``) or a timestamp; ``legacy_key``
    is ``"era"`` (core id from ``key_switch`` on, else all_transaction_id) or
    ``"all"`` (all_transaction_id); ``consumer_col=None`` takes the consumer
    from the cashback side; ``has_transaction_id=False`` takes the legacy
    transaction id from the promo side and none in the event era.
    """

    name: str
    date_col: str
    date_is_ts: bool
    fee_col: str
    wallet_col: str
    card_col: str
    type_col: str
    type_out_col: str
    consumer_col: str | None
    legacy_key: str = "all"
    core_id_col: str | None = None
    has_transaction_id: bool = True
    filter_col: str | None = None
    filter_value: object = None


PIX = ProductSpec(PRODUCT_NAMES[0], "adjusted_created_date", False, "payment_total_fee", "paid_wallet_value",
                  "paid_card_value", "transaction_type", "transaction_type", "consumer_id", legacy_key="era",
                  core_id_col="transactional_core_id", has_transaction_id=False,
                  filter_col="user_type", filter_value=CONSUMER_USER_TYPE)
P2P = ProductSpec(PRODUCT_NAMES[1], "created_at", True, "total_revenue", "paid_wallet_value", "paid_card_value",
                  "transaction_type", "transaction_type", "payer_id",
                  filter_col="is_business_transaction", filter_value=False)
BILLS = ProductSpec(PRODUCT_NAMES[2], "created_at", True, "total_revenue", "paid_balance_value", "paid_credit_card_value",
                    "payment_type", "payment_type", None)
VEHICULAR = ProductSpec(PRODUCT_NAMES[3], "created_at", True, "total_revenue", "paid_wallet_value",
                        "paid_card_value", "payment_type", "transaction_type", "consumer_id")
PRODUCTS = (PIX, P2P, BILLS, VEHICULAR)


#: A status event is one row per movement and status.
EVENT_KEY = ("properties_movement_id", "properties_status")


# --- shared frames -------------------------------------------------------------

def flagged_campaigns(taxonomy: DataFrame, pattern: str) -> DataFrame:
    """Campaigns whose requesting unit matches ``pattern``; one row per campaign.

    The survivor of duplicate campaign ids is the smallest (briefing,
    percentage), so reruns agree.
    """
    t = taxonomy.where(F.col("bu_solicitante").like(pattern))
    t = top_per_group(t, ["promo_campaign_id"], [F.col("briefing_id").asc_nulls_first(),
                                                 F.col("cashback_percentage").asc_nulls_first()])
    return t.select(F.col("promo_campaign_id").alias("campaign_id"), "briefing_id", "cashback_percentage",
                    F.lit(True).alias("is_flagged_campaign"))


def sent_campaigns(campaigns: DataFrame) -> DataFrame:
    """``campaigns`` marked for broadcast if there are at most ``CAMPAIGN_ROWS``: then no wide row is exchanged for its flag."""
    return F.broadcast(campaigns) if campaigns.count() <= CAMPAIGN_ROWS else campaigns


def _with_campaigns(rows: DataFrame, campaigns: DataFrame, p: CashbackParams) -> DataFrame:
    """Left join on ``campaign_id``; a campaign may hold a third of all rows."""
    if p.hot_share is None:
        return rows.join(campaigns, "campaign_id", "left")
    return salted_join(rows, campaigns, "campaign_id", "left", share=p.hot_share)


def promo_cashback(promo: DataFrame, campaigns: DataFrame, p: CashbackParams) -> DataFrame:
    """Legacy cashback rows with the era key and the campaign flag."""
    d = F.to_date("created_at")
    era_key = F.when(d >= date_lit(p.key_switch), F.col("transaction_id")).otherwise(F.col("all_transaction_id"))
    pr = promo.where(p.in_join_window(d)).select(
        era_key.alias("pix_id_cashback"), "promo_transaction_id", "campaign_id", "all_transaction_id",
        "transaction_id", "consumer_id", F.col("received_cashback_value").cast(MONEY).alias("received_cashback_value_promo"),
        F.col("paid_credit_card_value").cast(MONEY).alias("paid_credit_card_value_promo"))
    j = _with_campaigns(pr, campaigns, p)
    return j.withColumn("is_flagged_campaign", F.coalesce(F.col("is_flagged_campaign"), F.lit(False)))


def status_events(events: DataFrame, campaigns: DataFrame, core: DataFrame, p: CashbackParams,
                  dedupe_order=None, deduped: bool = False) -> DataFrame:
    """Event-era cashback (A18): CREATED events since the cut, flagged, with card value.

    Deduplicated on (movement, status) before the date filters, as the
    reference does; the status filter is pushed before the dedupe (it is part
    of the key, so the survivors are the same). ``dedupe_order`` fixes the
    survivor (default: event id). ``deduped``: the events are survivors already,
    as ``streaming.dedupe_state`` keeps them over many loads, and the whole
    history is not deduplicated again. Events of other days only compete in the
    dedupe: they take their key and order through its exchange and no more.
    """
    e = events.where(F.col("properties_status") == STATUS_CREATED)
    d = F.to_date("properties_created_at")
    wanted = p.in_join_window(d) & (d >= date_lit(p.cut))
    if not deduped:
        order = dedupe_order or ["id"]
        named = [o[0] if isinstance(o, tuple) else o for o in order]
        if all(isinstance(o, str) for o in named):
            e = e.withColumns({c: F.when(wanted, F.col(c)) for c in e.columns if c not in (*EVENT_KEY, *named)})
        e = top_per_group(e, list(EVENT_KEY), order)
    e = e.where(wanted)
    core_cond = p.in_join_window(F.to_date("created_at"))
    if p.core_min_year is not None:
        # Same rows as year(created_at) >= y, written as a range so it reaches the scan.
        core_cond = core_cond & (F.col("created_at") >= F.make_date(F.lit(p.core_min_year), F.lit(1), F.lit(1)))
    c = core.where(core_cond).select(F.col("correlation_id").alias("_core_id"),
                                     F.col("base_value").cast(MONEY).alias("_base_value"))
    j = (_with_campaigns(e.withColumn("campaign_id", F.col("properties_promo_campaign_id")), campaigns, p)
          .drop("campaign_id")
          .join(c, F.col("properties_origin_transaction_id") == F.col("_core_id"), "inner"))
    created = F.col("properties_status") == STATUS_CREATED
    expired = F.col("properties_status") == STATUS_EXPIRED
    return j.select(
        F.col("id").alias("cleaned_event_cashback_status_changed_id"),
        F.coalesce(F.col("is_flagged_campaign"), F.lit(False)).alias("is_flagged_campaign"),
        "properties_status",
        d.alias("created_date_cashback"),
        F.coalesce(F.col("properties_wallet_code_id") == INSTANT_WALLET_CODE, F.lit(False)).alias("is_instant_cash"),
        "properties_movement_id", "briefing_id", "cashback_percentage",
        F.col("properties_origin_transaction_id").alias("correlation_id"),
        F.col("properties_promo_campaign_id").alias("campaign_id"),
        F.col("user_id").alias("consumer_id"),
        F.when(created, F.col("properties_original_amount")).otherwise(F.lit(0)).cast(MONEY).alias("cashback_pago"),
        F.when(expired, F.col("properties_returned_amount")).otherwise(F.lit(0)).cast(MONEY).alias("cashback_raspado"),
        F.when(created, F.col("_base_value")).otherwise(F.lit(0)).alias("paid_credit_card_value_promo"))


# --- payments --------------------------------------------------------------------

def normalised_payments(table: DataFrame, spec: ProductSpec, p: CashbackParams) -> DataFrame:
    """One product's card payments in the window, with common column names."""
    d = F.col(spec.date_col)
    d = F.to_date(d) if spec.date_is_ts else d.cast("date")
    cond = p.in_window(d) & (F.col(spec.card_col) > 0)
    if spec.filter_col is not None:
        cond = cond & (F.col(spec.filter_col) == F.lit(spec.filter_value))
    core = F.col(spec.core_id_col).cast("string") if spec.core_id_col else F.lit(None).cast("string")
    if spec.legacy_key == "era":
        key_kind, key = F.lit("era"), F.when(d >= date_lit(p.key_switch), core).otherwise(
            F.col("all_transaction_id").cast("string"))
    else:
        key_kind, key = F.lit("all"), F.col("all_transaction_id").cast("string")
    return table.where(cond).select(
        F.lit(spec.name).alias("product_type_name"),
        d.alias("created_date"),
        F.col("all_transaction_id").cast("string").alias("all_transaction_id"),
        core.alias("transactional_core_id"),
        (F.col("transaction_id").cast("string") if spec.has_transaction_id else F.lit(None).cast("string"))
        .alias("pay_transaction_id"),
        F.lit(not spec.has_transaction_id).alias("txid_from_promo"),
        F.col("correlation_id").cast("string").alias("correlation_id"),
        F.col("credit_card_id").cast("long").alias("credit_card_id"),
        (F.col(spec.consumer_col).cast("long") if spec.consumer_col else F.lit(None).cast("long"))
        .alias("pay_consumer_id"),
        F.lit(spec.consumer_col is None).alias("consumer_from_cashback"),
        F.col("installments").cast("long").alias("installments"),
        F.col(spec.type_col).cast("string").alias("type_tested"),
        F.col(spec.type_out_col).cast("string").alias("transaction_type"),
        F.col(spec.wallet_col).cast(MONEY).alias("wallet_value"),
        F.col(spec.card_col).cast(MONEY).alias("card_value"),
        F.col(spec.fee_col).cast(MONEY).alias("fee_value"),
        key_kind.alias("key_kind"), key.alias("join_key"))


def all_payments(tables: dict[str, DataFrame], p: CashbackParams, specs=PRODUCTS) -> DataFrame:
    """Union of the normalised payments of every product present in ``tables``."""
    frames = [normalised_payments(tables[s.name], s, p) for s in specs if s.name in tables]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _branch(df: DataFrame, cashback_value: Column, as_of: DateLike, date_col: str, **cols) -> DataFrame:
    """Project one branch to ``BRANCH_SCHEMA``; the range label is computed
    from the projected value column, not from a copy of its expression."""
    cols.update(created_date=F.col(date_col), is_mtd=mtd_flag(date_col, as_of), cashback_value=cashback_value)
    first = df.select(*[cols.get(f.name, F.lit(None)).cast(f.dataType.simpleString()).alias(f.name)
                        for f in BRANCH_SCHEMA.fields if f.name != "cashback_range"])
    return first.select(*[value_bucket("cashback_value").alias(f.name) if f.name == "cashback_range"
                          else F.col(f.name) for f in BRANCH_SCHEMA.fields])


# --- branches ----------------------------------------------------------------------

def cashback_before(payments: DataFrame, promo_cb: DataFrame, p: CashbackParams) -> DataFrame:
    """Legacy-era product cashback (A21): one join for all products.

    The promo side is emitted once per key kind: the era key for products
    keyed by date, ``all_transaction_id`` for the others. Most of these rows
    match no payment (the other kind, the other era), so a bitmap of the
    payments' keys takes them out before the exchange.
    """
    pay = payments.where(F.col("created_date") < date_lit(p.cut))
    promo = promo_cb.select(
        "*", F.explode(F.array(
            F.struct(F.lit("era").alias("k"), F.col("pix_id_cashback").cast("string").alias("v")),
            F.struct(F.lit("all").alias("k"), F.col("all_transaction_id").cast("string").alias("v")))).alias("_key"))
    promo = promo.select(F.col("_key.k").alias("_kind"), F.col("_key.v").alias("_key"),
                         F.col("transaction_id").alias("promo_transaction_txid"),
                         F.col("consumer_id").alias("promo_consumer_id"),
                         "promo_transaction_id", "campaign_id", "briefing_id", "cashback_percentage",
                         "is_flagged_campaign", "received_cashback_value_promo", "paid_credit_card_value_promo")
    promo = with_partner(promo, ["_kind", "_key"], pay, ["key_kind", "join_key"])
    j = pay.join(promo, (F.col("key_kind") == F.col("_kind")) & (F.col("join_key") == F.col("_key")), "inner")
    value = allocate_cashback("wallet_value", "card_value", "type_tested", "received_cashback_value_promo",
                              "fee_value", "paid_credit_card_value_promo")
    return _branch(
        j, value, p.as_of, "created_date",
        all_transaction_id=F.col("all_transaction_id"), product_type_name=F.col("product_type_name"),
        type=F.lit(TYPE_CASHBACK), briefing_id=F.col("briefing_id"),
        cashback_percentage=F.col("cashback_percentage"), promo_transaction_id=F.col("promo_transaction_id"),
        campaign_id=F.col("campaign_id"), transactional_core_id=F.col("transactional_core_id"),
        transaction_id=F.when(F.col("txid_from_promo"), F.col("promo_transaction_txid"))
                        .otherwise(F.col("pay_transaction_id")),
        correlation_id=F.col("correlation_id"), is_flagged_campaign=F.col("is_flagged_campaign"),
        credit_card_id=F.col("credit_card_id"),
        consumer_id=F.when(F.col("consumer_from_cashback"), F.col("promo_consumer_id"))
                     .otherwise(F.col("pay_consumer_id")),
        installments=F.col("installments"), transaction_type=F.col("transaction_type"),
        paid_card_value=F.col("card_value"), total_revenue=F.col("fee_value"))


def cashback_after(payments: DataFrame, events_cb: DataFrame, p: CashbackParams) -> DataFrame:
    """Event-era product cashback (A22): one join on ``correlation_id`` for all products."""
    pay = payments.where(F.col("created_date") >= date_lit(p.cut))
    ev = events_cb.where(~F.col("is_instant_cash")).select(
        F.col("correlation_id").alias("_corr"), "cleaned_event_cashback_status_changed_id", "briefing_id",
        "cashback_percentage", "campaign_id", "is_flagged_campaign", F.col("consumer_id").alias("ev_consumer_id"),
        "cashback_pago", "paid_credit_card_value_promo")
    j = pay.join(ev, F.col("correlation_id") == F.col("_corr"), "inner")
    value = allocate_cashback("wallet_value", "card_value", "type_tested", "cashback_pago", "fee_value",
                              "paid_credit_card_value_promo")
    return _branch(
        j, value, p.as_of, "created_date",
        all_transaction_id=F.col("all_transaction_id"),
        cleaned_event_cashback_status_changed_id=F.col("cleaned_event_cashback_status_changed_id"),
        product_type_name=F.col("product_type_name"), type=F.lit(TYPE_CASHBACK),
        briefing_id=F.col("briefing_id"), cashback_percentage=F.col("cashback_percentage"),
        campaign_id=F.col("campaign_id"), transactional_core_id=F.col("transactional_core_id"),
        transaction_id=F.col("pay_transaction_id"), correlation_id=F.col("correlation_id"),
        is_flagged_campaign=F.col("is_flagged_campaign"), credit_card_id=F.col("credit_card_id"),
        consumer_id=F.when(F.col("consumer_from_cashback"), F.col("ev_consumer_id"))
                     .otherwise(F.col("pay_consumer_id")),
        installments=F.col("installments"), transaction_type=F.col("transaction_type"),
        paid_card_value=F.col("card_value"), total_revenue=F.col("fee_value"))


def instant_cash_before(instant: DataFrame, campaigns: DataFrame, p: CashbackParams) -> DataFrame:
    """Legacy instant cash of flagged campaigns."""
    d = F.to_date("created_at")
    cond = p.in_window(d)
    until = p.cut if p.instant_until == "cut" else p.instant_until
    if until is not None:
        cond = cond & (d < date_lit(until))
    j = instant.where(cond).join(campaigns, "campaign_id", "inner").withColumn("_d", d)
    value = F.col("instant_cash_given_value")
    return _branch(
        j, value, p.as_of, "_d", product_type_name=F.lit(INSTANT_PRODUCT), type=F.lit(TYPE_INSTANT),
        briefing_id=F.col("briefing_id"), cashback_percentage=F.col("cashback_percentage"),
        campaign_id=F.col("campaign_id"),
        is_flagged_campaign=F.coalesce(F.col("is_flagged_campaign"), F.lit(False)),
        consumer_id=F.col("consumer_id"), paid_card_value=F.lit(0))


def instant_cash_after(events_cb: DataFrame, p: CashbackParams) -> DataFrame:
    """Event-era instant cash of flagged campaigns."""
    e = events_cb.where(F.col("is_instant_cash") & F.col("is_flagged_campaign") & p.in_window(F.col("created_date_cashback")))
    return _branch(
        e, F.col(p.instant_value), p.as_of, "created_date_cashback",
        cleaned_event_cashback_status_changed_id=F.col("cleaned_event_cashback_status_changed_id"),
        product_type_name=F.lit(INSTANT_PRODUCT), type=F.lit(TYPE_INSTANT), briefing_id=F.col("briefing_id"),
        cashback_percentage=F.col("cashback_percentage"), campaign_id=F.col("campaign_id"),
        correlation_id=F.col("correlation_id"), is_flagged_campaign=F.col("is_flagged_campaign"),
        consumer_id=F.col("consumer_id"))


def event_era(payments: DataFrame, events_cb: DataFrame, p: CashbackParams) -> DataFrame:
    """``cashback_after`` and ``instant_cash_after`` from ONE pass over the events.

    Events LEFT JOIN event-era payments on ``correlation_id`` (instant events
    never match): a matched non-instant event gives the product rows (the
    inner-join fan-out is unchanged), an unmatched flagged instant event gives
    an instant-cash row, anything else is dropped. The deduplicated event
    frame is thus computed and shuffled once instead of once per branch.
    """
    pay = payments.where(F.col("created_date") >= date_lit(p.cut)).select(
        F.col("correlation_id").alias("_corr"), "product_type_name", "created_date", "all_transaction_id",
        "transactional_core_id", "pay_transaction_id", "credit_card_id", "pay_consumer_id",
        "consumer_from_cashback", "installments", "type_tested", "transaction_type", "wallet_value",
        "card_value", "fee_value")
    instant = F.col("is_instant_cash")
    given = F.col("is_flagged_campaign") & p.in_window(F.col("created_date_cashback"))
    # instant events that give no row go before the exchange
    j = events_cb.where(~instant | given).join(pay, (F.col("correlation_id") == F.col("_corr")) & ~instant, "left")
    j = j.where((instant & given) | (~instant & F.col("_corr").isNotNull()))
    product_value = allocate_cashback("wallet_value", "card_value", "type_tested", "cashback_pago", "fee_value",
                                      "paid_credit_card_value_promo")

    def pick(if_instant, if_product):
        return F.when(instant, if_instant).otherwise(if_product)

    none = F.lit(None)
    j = j.withColumn("_d", pick(F.col("created_date_cashback"), F.col("created_date")))
    return _branch(
        j, pick(F.col(p.instant_value), product_value), p.as_of, "_d",
        all_transaction_id=pick(none, F.col("all_transaction_id")),
        cleaned_event_cashback_status_changed_id=F.col("cleaned_event_cashback_status_changed_id"),
        product_type_name=pick(F.lit(INSTANT_PRODUCT), F.col("product_type_name")),
        type=pick(F.lit(TYPE_INSTANT), F.lit(TYPE_CASHBACK)),
        briefing_id=F.col("briefing_id"), cashback_percentage=F.col("cashback_percentage"),
        campaign_id=F.col("campaign_id"),
        transactional_core_id=pick(none, F.col("transactional_core_id")),
        transaction_id=pick(none, F.col("pay_transaction_id")),
        correlation_id=F.col("correlation_id"), is_flagged_campaign=F.col("is_flagged_campaign"),
        credit_card_id=pick(none, F.col("credit_card_id")),
        consumer_id=pick(F.col("consumer_id"), F.when(F.col("consumer_from_cashback"), F.col("consumer_id"))
                                                .otherwise(F.col("pay_consumer_id"))),
        installments=pick(none, F.col("installments")),
        transaction_type=pick(none, F.col("transaction_type")),
        paid_card_value=pick(none, F.col("card_value")), total_revenue=pick(none, F.col("fee_value")))


def cashback_branches(payment_tables: dict[str, DataFrame], promo: DataFrame, taxonomy: DataFrame,
                      instant: DataFrame, events: DataFrame, core: DataFrame, p: CashbackParams,
                      dedupe_order=None) -> DataFrame:
    """All ten branches (A21-A24) as one union with ``BRANCH_SCHEMA`` columns."""
    campaigns = flagged_campaigns(taxonomy, p.flag_pattern)
    if p.hot_share is None:
        campaigns = sent_campaigns(campaigns)
    pays = all_payments(payment_tables, p)
    ev = status_events(events, campaigns, core, p, dedupe_order)
    parts = [cashback_before(pays, promo_cashback(promo, campaigns, p), p),
             instant_cash_before(instant, campaigns, p),
             event_era(pays, ev, p)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


NATURAL_KEY = ("product_type_name", "type", "all_transaction_id", "promo_transaction_id",
               "cleaned_event_cashback_status_changed_id", "campaign_id", "consumer_id", "created_date")


def cashback_payments(branches: DataFrame, id_mode: str | None = "hash") -> DataFrame:
    """Unified fact (A25): id, 26 columns, year_month and y/M/d partition strings.

    ``id_mode``: ``"hash"`` = 128 bits of the natural key, the row and its number
    among equal rows (stable and unique, see ``numbered_key``), ``"monotonic"``
    = ``monotonically_increasing_id() + 1``, ``None`` = no id column.
    """
    d = F.col("created_date")
    cols = [
        "cleaned_event_cashback_status_changed_id", "promo_transaction_id", "campaign_id", "briefing_id",
        "transactional_core_id", "transaction_id", "correlation_id", "credit_card_id", "all_transaction_id",
        "consumer_id", "created_date", F.date_format(d, "y-MM").alias("year_month"), "type", "product_type_name",
        "transaction_type", "is_mtd", "is_flagged_campaign", "installments", "cashback_percentage",
        "cashback_range", F.col("cashback_value").alias("received_cashback_value"),
        F.col("paid_card_value").alias("paid_credit_card_value"), "total_revenue",
        F.date_format(d, "yyyy").alias("year_partition"), F.date_format(d, "MM").alias("month_partition"),
        F.date_format(d, "dd").alias("day_partition"),
    ]
    if id_mode is None:
        return branches.select(*cols)
    if id_mode == "hash":
        return numbered_key(branches.select(*cols), NATURAL_KEY, "cashback_payment_id")
    return branches.select((F.monotonically_increasing_id() + 1).alias("cashback_payment_id"), *cols)


def key_fanout(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once (they multiply rows in the joins above)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
