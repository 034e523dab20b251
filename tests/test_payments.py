import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.functions import dates
from ledgerlens.operators import payments

T = dt.datetime


def test_first_days_and_aggregate(spark):
    tx = spark.createDataFrame([
        (T(2024, 5, 3), 1, "3", "CREDIT_CARD", "PF", 100.0),
        (T(2024, 5, 7, 23), 2, "1", "BALANCE_AND_CREDIT_CARD", "PF", 50.0),
        (T(2024, 5, 8), 3, "1", "CREDIT_CARD", "PF", 70.0),        # day 8: out
        (T(2024, 6, 1), 1, None, "BALANCE", "PF", 30.0),
        (T(2024, 6, 2), 4, "2", "CREDIT_CARD", "PJ", 10.0),        # other type: out
        (T(2024, 6, 3), 1, "5", "CREDIT_CARD", "PF", 20.0),
    ], "adjusted_created_at timestamp_ntz, user_id long, installments string, payment_method string, "
       "pix_transaction_type string, paid_total_value_with_revenue double")
    f = payments.first_days_transactions(tx, day_limit=7)
    assert f.count() == 4
    r = f.where("user_id = 2").collect()[0]
    assert r.data_7 == dt.date(2024, 5, 14) and r.metodo_pagamento == "Cartao a vista"
    agg = {r.metodo_pagamento: r for r in payments.method_aggregate(f).collect()}
    assert agg["Cartao parcelado"].tpv == 120.0 and agg["Cartao parcelado"].transactions == 2
    assert agg["Cartao parcelado"].users == 1 and agg["Cartao parcelado"].avg_ticket == 120.0
    assert agg["Saldo carteira"].users == 1


def test_month_window_enriched_and_approved_base(spark):
    tx = spark.createDataFrame([
        (1, 10, T(2024, 3, 31, 8), True), (2, 11, T(2024, 2, 29), True), (3, 12, T(2024, 5, 1), True),
        (4, 10, T(2024, 4, 30), False), (5, 13, T(2024, 1, 31), True),
    ], "all_transaction_id long, consumer_id long, transaction_created_at timestamp_ntz, is_approved boolean")
    reg = spark.createDataFrame([(1, "doc"), (2, "doc2")], "all_transaction_id long, species_title string")
    cal = dates.calendar(spark, "2023-01-01", "2024-12-31")
    out = payments.month_window_enriched(tx, reg, cal, key="all_transaction_id", ts_col="transaction_created_at",
                                         analysis_months=2, frequency_months=2, as_of="2024-05-01",
                                         approved=F.col("is_approved"))
    got = {r.all_transaction_id: (r.calendar_date, r.species_title, r.is_month_end) for r in out.collect()}
    assert got == {1: (dt.date(2024, 3, 31), "doc", True), 2: (dt.date(2024, 2, 29), "doc2", True)}
    base = payments.approved_base(tx, consumer_col="consumer_id", ts_col="transaction_created_at",
                                  keep=(), since="2024-02-01")
    assert sorted(r.consumer_id for r in base.collect()) == [10, 11, 12]
