import random

import pytest
from pyspark.sql import Window, functions as F

from ledgerlens.operators import rank


def test_top_per_group_and_dedupe(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("b", 2, "w")], "k string, o int, v string")
    got = rank.top_per_group(df, ["k"], ["o", "v"]).collect()
    assert sorted((r.k, r.o, r.v) for r in got) == [("a", 1, "y"), ("b", 2, "w")]
    top2 = rank.top_per_group(df, ["k"], [F.col("o").desc(), "v"], n=2, rank_col="rn")
    assert top2.count() == 4 and "rn" in top2.columns
    assert rank.dedupe_by_key(df, ["k"]).count() == 2


@pytest.mark.parametrize("n1,n2", [(1, 1), (2, 5), (4, 4), (6, 50), (50, 60), (5, 3)])
def test_distinct_key_page_equals_dense_rank(spark, n1, n2):
    rnd = random.Random(n1 * 100 + n2)
    data = [(rnd.choice([None, 1, 2, 3, 5, 8, 13, 21, 34]), i) for i in range(60)]
    df = spark.createDataFrame(data, "consumer_id long, v long")
    want = (df.withColumn("dense_rank", F.dense_rank().over(Window.orderBy("consumer_id")))
              .where(F.col("dense_rank").between(n1, n2)))
    got = rank.distinct_key_page(df, n1, n2, key="consumer_id", partitions=3)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_dense_rank_keys_many_partitions(spark):
    df = spark.range(0, 1000).select((F.col("id") % 97).alias("k"))
    ranks = rank.dense_rank_keys(df, "k", partitions=7).orderBy("k").collect()
    assert [r.dense_rank for r in ranks] == list(range(1, 98))



def test_order_tuples(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2, 2), ("b", 1, 3), ("b", 1, 4)], "k string, o int, i int")
    got = rank.top_per_group(df, ["k"], [("o", "desc"), ("i", "asc")]).collect()
    assert sorted((r.k, r.i) for r in got) == [("a", 2), ("b", 3)]
    got = rank.top_per_group(df, ["k"], [("o", "desc_nulls_first"), ("i", "desc")]).collect()
    assert sorted((r.k, r.i) for r in got) == [("a", 1), ("b", 4)]


def test_distinct_key_page_with_hot_key(spark):
    # One key holds a third of all rows.
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.col("id") % 997).alias("k"),
                                     F.col("id").alias("v"))
    want = (df.withColumn("dense_rank", F.dense_rank().over(Window.orderBy("k")))
              .where(F.col("dense_rank").between(400, 700)))
    got = rank.distinct_key_page(df, 400, 700, key="k", partitions=5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # The hot key (rank 501) is on this page with every one of its rows.
    assert got.where("k = 500").count() == df.where("k = 500").count() >= 1000


def test_large_n_two_level_equals_window(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", "b"]), rnd.random(), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, u double, i long")
    got = rank.top_per_group(df, ["k"], ["u", "i"], n=1500)
    w = Window.partitionBy("k").orderBy("u", "i")
    want = df.withColumn("_r", F.row_number().over(w)).where("_r <= 1500").drop("_r")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("k = 'hot'").count() == 1500
