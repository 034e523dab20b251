import statistics

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlens.operators import skew


def hot_frame(spark, n=30000):
    """One key with a third of the rows, null with a fifth, the rest all different; every row apart."""
    k = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 1, None).otherwise(F.col("id") + 1000)
    return spark.range(n).select(k.cast("long").alias("k"), F.col("id").alias("v"), F.lit("s").alias("_salt"))


def test_every_key_above_the_share_is_found(spark):
    n, hot = skew.frequent_keys(hot_frame(spark), ["k"], 0.01)
    assert n == 30000 and len(hot) == 2 and hot[None] >= 4000 and max(hot.values()) >= 10000
    flat = spark.range(20000).select((F.col("id") % 300).alias("k"))
    assert len(skew.frequent_keys(flat, ["k"], 0.001)[1]) == 300 and skew.frequent_keys(flat, ["k"], 0.01)[1] == {}
    assert skew.frequent_keys(flat.limit(0), ["k"])[1] == {}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_as_a_plain_join(spark, how):
    left = hot_frame(spark, 3000)
    right = spark.range(0, 4000, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"), F.lit("t").alias("_SALT_")).unionAll(
        spark.createDataFrame([(7, 1, "t"), (7, 2, "t"), (7, 2, "t"), (None, 3, "t")], "k long, w long, _SALT_ string"))
    assert rows(skew.salted_join(left, right, "k", how)) == rows(left.join(right, "k", how))
    two = skew.salted_join(left.withColumn("j", F.col("v") % 2), right.withColumn("j", F.col("w") % 2), ["k", "j"], how, share=0.1)
    assert rows(two) == rows(left.withColumn("j", F.col("v") % 2).join(right.withColumn("j", F.col("w") % 2), ["k", "j"], how))
    assert skew.salted_join(left.limit(0), right, "k", how).count() == 0
    assert rows(skew.salted_join(left, right.limit(0), "k", how)) == rows(left.join(right.limit(0), "k", how))


def test_other_joins_are_refused(spark):
    with pytest.raises(ValueError):
        skew.salted_join(hot_frame(spark), hot_frame(spark), "k", "full")


def test_the_largest_task_is_below_twice_the_median(spark):
    """Shuffled, without adaptive help: 32 tasks, a key with a third of all rows, nulls with a fifth."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        left, right = hot_frame(spark, 60000), spark.range(70000).select(F.col("id").alias("k"), F.lit(1).alias("w"))

        def sizes(joined):
            return [r[1] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]

        plain, salted = sizes(left.join(right, "k", "left")), sizes(skew.salted_join(left, right, "k", "left"))
        assert sum(plain) == sum(salted) == 60000
        assert max(plain) > 5 * statistics.median(plain)
        assert len(salted) == 32 and max(salted) < 2 * statistics.median(salted)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
