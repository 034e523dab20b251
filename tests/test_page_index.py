import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlens.operators import rank
from ledgerlens.sources import page_index as P


def frame(spark):
    """A key with a third of the rows, null keys, repeated rows, a column named like the rank."""
    k = F.when(F.col("id") % 3 == 0, 40).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 97)
    one = spark.range(900).select(k.cast("int").alias("k"), F.col("id").alias("v"))
    return one.unionAll(one.where("v < 20"))


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_pages_are_those_of_the_ranked_keys(spark, tmp_dir, parts):
    df = frame(spark)
    P.write_page_index(df, "k", f"{tmp_dir}/i", parts)
    ranked = rank.dense_rank_keys(df, "k")
    for n1, n2 in ((1, 1), (1, 5), (2, 3), (38, 44), (90, 500), (400, 500), (5, 4), (-3, 2)):
        assert rows(P.read_page(spark, f"{tmp_dir}/i", n1, n2, "k")) == rows(rank.distinct_key_page(df, n1, n2, "k", ranked=ranked)), (n1, n2)


def test_a_page_opens_its_own_parts_only(spark, tmp_dir):
    df = spark.range(10_000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 20).alias("w"))
    P.write_page_index(df, "k", f"{tmp_dir}/i", 50)
    page = P.read_page(spark, f"{tmp_dir}/i", 4000, 4300, "k")
    assert page.count() == 301
    parts = {p for p, first, last in P._first_ranks(spark, f"{tmp_dir}/i") if first <= 4300 and last >= 4000}
    assert len(parts) <= 5
    read = spark.read.parquet(f"{tmp_dir}/i/rows").where(F.col(P.PART).isin(list(parts))).select(F.input_file_name()).distinct()
    assert read.count() <= len(parts)
    plan = page._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [page_part" in s or "PartitionFilters: [isnotnull(page_part" in s for s in scans)
    sizes = [r[1] for r in spark.read.parquet(f"{tmp_dir}/i/rows").groupBy(P.PART).count().collect()]
    assert max(sizes) < 4 * sum(sizes) / len(sizes)


def test_a_hot_key_is_spread_and_empty_tables_are_pages_too(spark, tmp_dir):
    df = spark.range(3000).select(F.lit(5).alias("k"), F.col("id").alias("v"))
    P.write_page_index(df, "k", f"{tmp_dir}/hot", 8)
    assert len(P._first_ranks(spark, f"{tmp_dir}/hot")) > 4 and {(a, b) for _, a, b in P._first_ranks(spark, f"{tmp_dir}/hot")} == {(1, 1)}
    assert P.read_page(spark, f"{tmp_dir}/hot", 1, 1, "k").count() == 3000 and P.read_page(spark, f"{tmp_dir}/hot", 2, 9, "k").count() == 0
    P.write_page_index(df.where("k = 6"), "k", f"{tmp_dir}/none")
    none = P.read_page(spark, f"{tmp_dir}/none", 1, 9, "k")
    assert none.count() == 0 and none.columns == ["k", "v", "dense_rank"]
    with pytest.raises(ValueError):
        P.write_page_index(df.withColumn(P.PART, F.lit(1)), "k", f"{tmp_dir}/x")
