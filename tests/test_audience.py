from pyspark.sql import functions as F

from ledgerlens.operators import audience


def base(spark, n=3000):
    return spark.range(n).select((F.col("id") % 1000).alias("consumer_id"),
                                 F.element_at(F.array(F.lit("mixed"), F.lit("credit"), F.lit("balance")),
                                              (F.col("id") % 3 + 1).cast("int")).alias("payment_distribution"))


def test_split_disjoint_capped_deterministic(spark):
    df = base(spark)
    a = audience.audience_split(df, weights=(0.1, 0.1, 0.1), cap=200, seed=3)
    b = audience.audience_split(df.repartition(5), weights=(0.1, 0.1, 0.1), cap=200, seed=3)
    ra, rb = {tuple(r) for r in a.collect()}, {tuple(r) for r in b.collect()}
    assert ra == rb                                           # independent of partitioning
    counts = {r.grupos: r["count"] for r in a.groupBy("grupos").count().collect()}
    assert set(counts) == {"Grupo 1", "Grupo 2", "Grupo 3"} and all(v == 200 for v in counts.values())
    assert a.select("consumer_id").distinct().count() == a.count()   # disjoint
    uncapped = audience.audience_split(df, cap=None, seed=3)
    assert uncapped.count() == 1000
    sizes = sorted(r["count"] for r in uncapped.groupBy("grupos").count().collect())
    assert sizes[0] > 250 and sizes[-1] < 420


def test_stratified_sample(spark):
    df = base(spark)
    s = audience.stratified_sample(df, "payment_distribution", strata=["mixed", "credit"], fraction=0.5,
                                   seed=123, cap=None)
    per = {r.payment_distribution: r["count"] for r in s.groupBy("payment_distribution").count().collect()}
    assert set(per) == {"mixed", "credit"}
    assert all(420 < v < 580 for v in per.values())           # about half of 1,000 distinct pairs
    capped = audience.stratified_sample(df, "payment_distribution", fraction=0.5, seed=123, cap=50)
    assert all(r["count"] == 50 for r in capped.groupBy("payment_distribution").count().collect())
    again = audience.stratified_sample(df, "payment_distribution", fraction=0.5, seed=123, cap=50)
    assert {tuple(r) for r in capped.collect()} == {tuple(r) for r in again.collect()}


def test_random_split_groups_shape(spark):
    out = audience.random_split_groups(base(spark).select("consumer_id"), seed=1, cap=10)
    assert out.count() == 30 and out.select("grupos").distinct().count() == 3


def test_bernoulli_sample(spark):
    df = spark.range(4000).select(F.col("id").alias("consumer_id"))
    n = audience.bernoulli_sample(df, 0.5, 123, cap=None).count()
    assert 1800 < n < 2200
    assert audience.bernoulli_sample(df, 0.5, 123, cap=100).count() == 100


def test_hash_bits_pinned(spark):
    # md5('123|7') starts with 03cf763289554 (hex) = 67033218192724; DuckDB gives the same.
    df = spark.createDataFrame([(123,)], "consumer_id long")
    assert df.select(audience.hash_bits("consumer_id", seed=7)).first()[0] == 67033218192724
    assert audience.split_thresholds((1, 1)) == [audience.HASH_SCALE // 2]
    assert audience.fraction_threshold(0.25) == audience.HASH_SCALE // 4


def test_caps_by_histogram_equal_the_ranked_cap(spark):
    from pyspark.sql import Window
    from ledgerlens.operators import rank
    rows = [("a", i) for i in range(3000)] + [("b", i) for i in range(40)] + [(None, i) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, k long").withColumn("h", audience.hash_bits("k", F.coalesce("g", F.lit("-")), seed=3))
    df = df.unionByName(df.where("k < 5").withColumn("k", F.col("k") + 9000))      # equal bits: the key decides
    for n in (1, 39, 41, 95, 2000, 10_000):
        want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h", "k"))).where(F.col("r") <= n).drop("r")
        for high in (1, 6, 12):
            got = rank.cap_by_bits(df, "g", "h", "k", n, audience.HASH_BITS, high)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
