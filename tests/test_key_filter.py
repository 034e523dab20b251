import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import key_filter


def test_rows_with_a_partner_stay_and_most_others_go(spark):
    rows = spark.range(40_000).select(F.concat(F.lit("A"), "id").alias("k"), (F.col("id") % 3).alias("kind"), F.lit(1).alias("_place"))
    rows = rows.unionAll(spark.createDataFrame([(None, 0, 1), ("A7", None, 1)], "k string, kind long, _place int"))
    others = rows.where("kind = 1 AND k LIKE '%7'").select(F.col("k").alias("key"), F.col("kind").alias("which")).unionAll(
        spark.createDataFrame([(None, 1), ("A7", None)], "key string, which long"))
    kept = key_filter.with_partner(rows, ["kind", "k"], others, ["which", "key"])
    same = (F.col("kind") == F.col("which")) & (F.col("k") == F.col("key"))
    want = sorted(r.k for r in rows.join(others, same).collect())
    assert kept.columns == rows.columns and sorted(r.k for r in kept.join(others, same).collect()) == want
    assert len(want) <= kept.count() <= len(want) + 20


def test_clashing_places_lose_no_row(spark, monkeypatch):
    monkeypatch.setattr(key_filter, "SENT_BITS", 64)
    rows, others = spark.range(-500, 500), spark.range(-90, 900, 9).select(F.col("id").alias("o"))
    kept = key_filter.with_partner(rows, ["id"], others, ["o"])
    assert kept.join(others, F.col("id") == F.col("o")).count() == 66
    assert key_filter.with_partner(rows, ["id"], others.limit(0), ["o"]).count() == 0


def test_keys_of_other_types_are_refused(spark):
    with pytest.raises(ValueError):
        key_filter.with_partner(spark.range(3), ["id"], spark.range(3).select(F.col("id").cast("int").alias("o")), ["o"])
