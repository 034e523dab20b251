import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import profile, reshape


def sensor_frame(spark):
    return spark.createDataFrame([("north", 4.5, None, 7.25), ("south", -1.0, 3.0, 0.0), ("west", None, None, 2.5), ("east", 8.0, 6.0, 1.0)],
                                 "station string, dawn double, noon double, dusk double")


def test_unpivot_keeps_nulls_and_pivot_restores(spark):
    readings = reshape.unpivot(sensor_frame(spark), ["station"], {"t1": "dawn", "t2": "noon", "t3": "dusk"}, var_name="slot", value_name="celsius")
    assert readings.columns == ["station", "slot", "celsius"]
    by_slot = {r.slot: (r.n, r.k) for r in readings.groupBy("slot").agg(F.count("*").alias("n"), F.count("celsius").alias("k")).collect()}
    assert by_slot == {"t1": (4, 3), "t2": (4, 2), "t3": (4, 4)}
    wide = reshape.pivot(readings, ["station"], "slot", F.max("celsius"), values=["t1", "t2", "t3"])
    assert sorted(map(tuple, wide.na.fill(99.0).collect())) == sorted(
        map(tuple, sensor_frame(spark).na.fill(99.0).collect()))


def test_unpivot_plain_list(spark):
    got = reshape.unpivot(sensor_frame(spark).where("station = 'east'"), ["station"], ["dawn", "dusk"]).collect()
    assert sorted((r.key, r.value) for r in got) == [("dawn", 8.0), ("dusk", 1.0)]


def test_pivot_takes_unlisted_values_under_other(spark):
    sales = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 9, 11), ("b", None, 3)], "k string, q int, v int")
    rows = {r.k: (r["1"], r["2"], r["rest"]) for r in reshape.pivot(sales, ["k"], "q", F.sum("v"), values=[1, 2], other="rest").collect()}
    assert rows == {"a": (5, 7, 11), "b": (None, None, 3)}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_exact_quantiles_are_discrete(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        values = [3.0] * 50 + [1.0, 2.0, 9.0, 10.0] + [None] * 5 + list(map(float, range(100, 146)))
        df = spark.createDataFrame([(v, None) for v in values], "x double, empty int")
        r = {q.column_name: (q.p25, q.p50, q.p75) for q in profile.exact_quantiles(df, ["x", "empty"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    ordered = sorted(v for v in values if v is not None)
    assert r == {"x": tuple(ordered[-(-len(ordered) * k // 4) - 1] for k in (1, 2, 3))}


def test_column_stats_and_summary(spark):
    df = spark.range(0, 201, 2).select((F.col("id") / 4).alias("u"))
    s = profile.column_stats(df, ["u"]).first()
    assert (s["count"], s["min"], s["max"], s["mean"]) == (101, 0.0, 50.0, 25.0)
    assert abs(s["p50"] - 25) <= 0.5
    assert [r.u for r in profile.summary(df, ["u"], ["min", "max"]).collect()] == ["0.0", "50.0"]


def test_profile_names_types_and_uniqueness(spark):
    p = profile.table_profile(sensor_frame(spark), "sensors").first()
    assert (p.table_name, p.n_rows, p.n_cols) == ("sensors", 4, 4)
    assert p.columns_sorted == "dawn,dusk,noon,station"
    assert p.schema_sorted == "dawn double,dusk double,noon double,station string"
    assert profile.alphabetical(sensor_frame(spark)).columns == ["dawn", "dusk", "noon", "station"]
    twice = sensor_frame(spark).union(sensor_frame(spark))
    assert tuple(profile.uniqueness_check(twice, "station").first()) == (4, 8)
