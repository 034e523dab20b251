import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.operators import cashback as CB

T = dt.datetime
P = CB.CashbackParams(start="2024-01-01", end="2024-12-31", cut="2024-11-01", key_switch="2024-07-01",
                      flag_pattern="%UNIT%", as_of="2024-12-15", core_min_year=2024)


def frames(spark):
    pix = spark.createDataFrame([
        (dt.date(2024, 6, 1), "CONSUMER", 100.0, 0.0, 2.0, "SINGLE", "T1", "A1", "C1", 9, 501, 1),
        (dt.date(2024, 8, 1), "CONSUMER", 100.0, 0.0, 2.0, "MULTIPLE_CARDS", "T2", "A2", "C2", 9, 502, 1),
        (dt.date(2024, 6, 30), "CONSUMER", 100.0, 0.0, 2.0, "SINGLE", "T3", "A3", "C3", 9, 503, 1),
        (dt.date(2024, 11, 5), "CONSUMER", 100.0, 0.0, 2.0, "SINGLE", "T4", "A4", "C4", 9, 504, 1),
        (dt.date(2024, 11, 6), "BUSINESS", 100.0, 0.0, 2.0, "SINGLE", "T5", "A5", "C5", 9, 505, 1),
    ], "adjusted_created_date date, user_type string, paid_card_value double, paid_wallet_value double, "
       "payment_total_fee double, transaction_type string, transactional_core_id string, all_transaction_id string, "
       "correlation_id string, credit_card_id long, consumer_id long, installments long")
    bills = spark.createDataFrame([
        (T(2024, 3, 1), 50.0, 0.0, 1.0, "SINGLE", "B1", "BT1", "BC1", 7, 1),
        (T(2024, 11, 20), 50.0, 0.0, 1.0, "SINGLE", "B2", "BT2", "BC2", 7, 1),
    ], "created_at timestamp_ntz, paid_credit_card_value double, paid_balance_value double, total_revenue double, "
       "payment_type string, all_transaction_id string, transaction_id string, correlation_id string, "
       "credit_card_id long, installments long")
    promo = spark.createDataFrame([
        (T(2024, 6, 1), "P1", 1, "A1", "T1", 601, 5.0, 100.0),     # before switch: key all_transaction_id
        (T(2024, 8, 1), "P2", 2, "A2", "T2", 602, 20.0, 50.0),     # after switch: key transaction id
        (T(2024, 7, 2), "P3", 1, "A3", "T3", 603, 5.0, 100.0),     # promo after switch, payment before: no match
        (T(2024, 3, 1), "PB", 1, "B1", "BT1", 777, 3.0, 50.0),     # bills: consumer from promo side
        (T(2024, 3, 1), "PB2", 2, "B1", "BT1", 778, 4.0, 50.0),    # same key twice: fan-out
    ], "created_at timestamp_ntz, promo_transaction_id string, campaign_id long, all_transaction_id string, "
       "transaction_id string, consumer_id long, received_cashback_value double, paid_credit_card_value double")
    taxonomy = spark.createDataFrame([(1, "UNIT-A", "b1", 0.1), (1, "UNIT-A", "b0", 0.2), (2, "OTHER", "b2", 0.3),
                                      (3, "UNIT-B", "b3", 0.4)],
                                     "promo_campaign_id long, bu_solicitante string, briefing_id string, "
                                     "cashback_percentage double")
    instant = spark.createDataFrame([(3, 900, T(2024, 5, 1), 12.0), (2, 901, T(2024, 5, 1), 12.0),
                                     (3, 902, T(2024, 11, 2), 12.0)],
                                    "campaign_id long, consumer_id long, created_at timestamp_ntz, "
                                    "instant_cash_given_value double")
    events = spark.createDataFrame([
        ("E1", 701, 1, "CREATED", T(2024, 11, 5), 1, 1, "C4", 8.0, 0.0),
        ("E1b", 701, 1, "CREATED", T(2024, 11, 5), 1, 1, "C4", 9.0, 0.0),   # duplicate (movement, status)
        ("E2", 702, 2, "CREATED", T(2024, 11, 20), None, 2, "BC2", 6.0, 0.0),
        ("E3", 703, 3, "CREATED", T(2024, 11, 25), 419, 3, "C9", 11.0, 1.0),  # instant, flagged
        ("E4", 704, 4, "EXPIRED", T(2024, 11, 25), 1, 1, "C4", 0.0, 4.0),
    ], "id string, user_id long, properties_movement_id long, properties_status string, "
       "properties_created_at timestamp_ntz, properties_wallet_code_id int, properties_promo_campaign_id long, "
       "properties_origin_transaction_id string, properties_original_amount double, "
       "properties_returned_amount double")
    core = spark.createDataFrame([("C4", T(2024, 11, 5), 100.0), ("BC2", T(2024, 11, 20), 50.0),
                                  ("C9", T(2024, 11, 25), 10.0)],
                                 "correlation_id string, created_at timestamp_ntz, base_value double")
    return {"PIX": pix, "BILLS": bills}, promo, taxonomy, instant, events, core


def test_branches(spark):
    tables, promo, taxonomy, instant, events, core = frames(spark)
    out = CB.cashback_branches(tables, promo, taxonomy, instant, events, core, P, dedupe_order=["id"])
    got = {(r.product_type_name, r.all_transaction_id, r.promo_transaction_id,
            r.cleaned_event_cashback_status_changed_id): r for r in out.collect()}
    assert set(got) == {("PIX", "A1", "P1", None), ("PIX", "A2", "P2", None), ("BILLS", "B1", "PB", None),
                        ("BILLS", "B1", "PB2", None), ("Instant Cash", None, None, None),
                        ("PIX", "A4", None, "E1"), ("BILLS", "B2", None, "E2"),
                        ("Instant Cash", None, None, "E3")}
    a1 = got[("PIX", "A1", "P1", None)]
    assert (a1.cashback_value, a1.cashback_range, a1.is_flagged_campaign, a1.briefing_id) == (5.0, "01. até 10", True, "b0")
    assert a1.transaction_id == "T1" and a1.consumer_id == 501 and a1.is_mtd is True
    a2 = got[("PIX", "A2", "P2", None)]
    assert float(a2.cashback_value) == 20.0 * ((100.0 - 2.0) / 50.0) and a2.is_flagged_campaign is False
    assert got[("BILLS", "B1", "PB", None)].consumer_id == 777          # bills: consumer from promo
    e1 = got[("PIX", "A4", None, "E1")]
    assert e1.cashback_value == 8.0 and e1.transaction_id is None and e1.consumer_id == 504
    assert got[("BILLS", "B2", None, "E2")].consumer_id == 702          # bills: consumer from event
    legacy_instant = got[("Instant Cash", None, None, None)]
    assert legacy_instant.consumer_id == 900 and legacy_instant.paid_card_value == 0.0
    assert got[("Instant Cash", None, None, "E3")].cashback_value == 11.0
    fact = CB.cashback_payments(out)
    assert fact.columns[0] == "cashback_payment_id" and len(fact.columns) == 27
    assert fact.select("cashback_payment_id").distinct().count() == fact.count()
    r = fact.where("all_transaction_id = 'A1'").collect()[0]
    assert (r.year_month, r.year_partition, r.month_partition, r.day_partition) == ("2024-06", "2024", "06", "01")


def test_literal_instant_value_and_no_until(spark):
    tables, promo, taxonomy, instant, events, core = frames(spark)
    import dataclasses
    lit = dataclasses.replace(P, instant_value="cashback_raspado", instant_until=None)
    out = CB.cashback_branches(tables, promo, taxonomy, instant, events, core, lit, dedupe_order=["id"])
    inst = out.where("product_type_name = 'Instant Cash'").collect()
    assert sorted(r.consumer_id for r in inst) == [703, 900, 902]     # legacy row after the cut kept
    assert [r.cashback_value for r in inst if r.consumer_id == 703] == [0.0]


def test_key_fanout(spark):
    _, promo, *_ = frames(spark)
    assert [r.all_transaction_id for r in CB.key_fanout(promo, "all_transaction_id").collect()] == ["B1"]


def test_event_era_equals_separate_branches(spark):
    tables, promo, taxonomy, instant, events, core = frames(spark)
    camp = CB.flagged_campaigns(taxonomy, P.flag_pattern)
    pays = CB.all_payments(tables, P)
    ev = CB.status_events(events, camp, core, P, ["id"])
    one = {tuple(r) for r in CB.event_era(pays, ev, P).collect()}
    two = {tuple(r) for r in CB.cashback_after(pays, ev, P).unionByName(CB.instant_cash_after(ev, P)).collect()}
    assert one == two and len(one) == 3


def test_a_bounded_number_of_campaigns_is_sent_and_no_row_exchanged_for_its_flag(spark, monkeypatch):
    tables, promo, taxonomy, instant, events, core = frames(spark)
    taxonomy = taxonomy.unionByName(spark.createDataFrame([(None, "UNIT-N", "n", 0.5), (3, "UNIT-B", None, None)], taxonomy.schema))
    promo = promo.unionByName(promo.limit(2).withColumn("campaign_id", F.lit(None).cast("long")))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def made():
            out = CB.cashback_branches(tables, promo, taxonomy, instant, events, core, P, dedupe_order=["id"])
            return out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(campaign_id"), sorted(map(str, out.collect()))
        sent, rows_sent = made()
        monkeypatch.setattr(CB, "CAMPAIGN_ROWS", 0)
        exchanged, rows_exchanged = made()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sent == 0 and exchanged >= 3 and rows_sent == rows_exchanged and len(rows_sent) >= 8


def test_events_of_other_days_compete_in_the_dedupe_without_their_columns(spark):
    _, _, taxonomy, _, events, core = frames(spark)
    camp = CB.flagged_campaigns(taxonomy, P.flag_pattern)
    core = core.unionByName(spark.createDataFrame([("C5", T(2024, 11, 7), 10.0)], core.schema))
    more = spark.createDataFrame([("D1", 1, 8, "CREATED", T(2024, 1, 5), 1, 1, "C5", 1.0, 0.0),      # before the cut, and best: beats the next
                                  ("D2", 1, 8, "CREATED", T(2024, 11, 7), 1, 1, "C5", 2.0, 0.0),
                                  ("D3", 1, 9, "CREATED", T(2024, 11, 7), 1, 1, "C5", 3.0, 0.0),      # best, although the next is older
                                  ("D4", 1, 9, "CREATED", T(2024, 1, 5), 1, 1, "C5", 4.0, 0.0),
                                  ("D5", 1, None, "CREATED", T(2024, 11, 7), 1, 1, "C5", 5.0, 0.0),
                                  ("D6", 1, 10, "CREATED", None, 1, 1, "C5", 6.0, 0.0)], events.schema)
    for order in (["id"], [("id", "asc")], [F.col("id")]):
        out = CB.status_events(events.unionByName(more), camp, core, P, order)
        got = {r.cleaned_event_cashback_status_changed_id: float(r.cashback_pago) for r in out.collect()}
        assert got == {"E1": 8.0, "E2": 6.0, "E3": 11.0, "D3": 3.0, "D5": 5.0}
    plan = CB.status_events(events, camp, core, P, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Window"):].count("CASE WHEN") >= 5          # emptied below the dedupe


def test_promo_rows_without_a_payment_are_not_exchanged(spark):
    tables, promo, taxonomy, *_ = frames(spark)
    many = promo.unionByName(spark.range(2000).select(F.lit(T(2024, 6, 1)).cast("timestamp_ntz").alias("created_at"), F.concat(F.lit("X"), "id").alias("promo_transaction_id"),
                             F.lit(1).cast("long").alias("campaign_id"), F.concat(F.lit("Z"), "id").alias("all_transaction_id"), F.concat(F.lit("Y"), "id").alias("transaction_id"),
                             F.lit(1).cast("long").alias("consumer_id"), F.lit(1.0).alias("received_cashback_value"), F.lit(2.0).alias("paid_credit_card_value")))
    camp = CB.flagged_campaigns(taxonomy, P.flag_pattern)
    out = CB.cashback_before(CB.all_payments(tables, P), CB.promo_cashback(many, camp, P), P)
    assert sorted(r.promo_transaction_id for r in out.collect()) == ["P1", "P2", "PB", "PB2"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD [_block" in plan and plan.index("_kind") < plan.index("LogicalRDD [_block")
