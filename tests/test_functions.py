import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.functions import dates as D


def test_value_bucket_bounds(spark):
    vals = [(-1.0,), (0.0,), (10.0,), (10.01,), (50.0,), (1000.0,), (1000.01,), (None,)]
    df = spark.createDataFrame(vals, "v double")
    got = [r[0] for r in df.select(C.value_bucket("v")).collect()]
    by_col = [r[0] for r in df.select(C.value_bucket(F.col("v"))).collect()]
    assert got == ["01. até 10", "01. até 10", "01. até 10", "02. até 50", "02. até 50",
                   "12. até 1000", "13. acima de 1000", "outro"]
    assert by_col == got


def test_allocation_rules(spark):
    schema = "wallet double, card double, type string, cb double, fee double, total double"
    data = [
        (5.0, 100.0, "SINGLE", 10.0, 1.0, 100.0),          # wallet part -> 0
        (None, 100.0, "SINGLE", 10.0, 1.0, 100.0),         # null wallet, single -> cashback
        (0.0, 100.0, None, 10.0, 1.0, 100.0),              # null type -> 0
        (0.0, 100.0, "multiple_cards", 10.0, 2.0, 49.0),   # lower-case multi -> pro rata
        (0.0, 100.0, "SINGLE", None, 1.0, 100.0),          # null cashback, single -> 0
        (0.0, 100.0, "MULTIPLE_CARDS", None, 1.0, 100.0),  # null cashback, multi -> null
        (0.0, 100.0, "MULTIPLE_CARDS", 10.0, 1.0, 0.0),    # zero total -> null
        (0.0, 100.0, "MULTIPLE_CARDS", 10.0, 1.0, None),   # null total -> null
        (0.0, 0.0, "SINGLE", 10.0, 1.0, 100.0),            # no card -> 0
    ]
    df = spark.createDataFrame(data, schema)
    by_name = [r[0] for r in df.select(C.allocate_cashback("wallet", "card", "type", "cb", "fee", "total")).collect()]
    by_col = [r[0] for r in df.select(C.allocate_cashback(F.col("wallet"), F.col("card"), F.col("type"),
                                                          F.col("cb"), F.col("fee"), F.col("total"))).collect()]
    assert by_name == by_col
    assert by_name[:5] == [0, 10.0, 0, 10.0 * ((100.0 - 2.0) / 49.0), 0]
    assert by_name[5:8] == [None, None, None]
    assert by_name[8] == 0


def test_payment_method_class(spark):
    df = spark.createDataFrame([("3", "CREDIT_CARD"), ("1", "BALANCE_AND_CREDIT_CARD"), ("1", "BALANCE"),
                                (None, "CREDIT_CARD"), ("x", "CREDIT_CARD")], "n string, m string")
    got = [r[0] for r in df.select(C.payment_method_class("n", "m")).collect()]
    assert got == ["Cartao parcelado", "Cartao a vista", "Saldo carteira", "Saldo carteira", "Saldo carteira"]


def test_later_of_keeps_null_effective(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1)),
                                (dt.datetime(2024, 1, 1), None), (None, dt.datetime(2024, 1, 3))],
                               "a timestamp, b timestamp")
    got = [r[0] for r in df.select(D.later_of(F.col("a"), F.col("b"))).collect()]
    assert got == [dt.datetime(2024, 1, 2), None, dt.datetime(2024, 1, 3)]


def test_mtd_flag_and_month_labels(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 5),), (dt.date(2024, 3, 20),), (None,)], "d date")
    assert [r[0] for r in df.select(D.mtd_flag("d", "2024-04-10")).collect()] == [True, False, False]
    labels = D.month_labels(df, "d", n=3).collect()[0]
    assert labels["mes_referencia"] == dt.date(2024, 3, 20)
    assert [labels["m_0"], labels["m_1"], labels["m_2"]] == ["2024/03", "2024/02", "2024/01"]


def test_calendar(spark):
    cal = D.calendar(spark, "2024-01-30", "2024-02-02").collect()
    assert [r.calendar_date for r in cal] == [dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 2, 1),
                                              dt.date(2024, 2, 2)]
    assert [r.is_month_end for r in cal] == [False, True, False, False]
    assert len(D.calendar(spark, "2024-01-30", "2024-02-02", include_end=False).collect()) == 3


def test_shift_hours_crosses_midnight(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 5, 1, 1, 0),)], "t timestamp_ntz")
    assert df.select(D.shift_hours("t", -3)).collect()[0][0] == dt.datetime(2024, 4, 30, 22, 0)
