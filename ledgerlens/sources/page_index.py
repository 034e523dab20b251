"""Rows clustered by key, with a table of boundaries: a page of keys opens the files that hold it and no others.

``distinct_key_page`` ranks all keys for its first page. Where pages of one
table are read again and again, the rows are written once in key order, cut
into parts by ranges of the key; a hot key is spread over several parts. The
boundary table has one row per part: its first and last key and its number of
distinct keys, so the rank of every part's first key is a running sum over a
few numbers. A page finds its parts there; the parts are folders, and all others
are pruned before a file is opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.rank import free_name

PART = "page_part"


def write_page_index(df: DataFrame, key: str, path: str, parts: int | None = None) -> None:
    """Write ``df`` below ``path`` in ascending order of ``key`` (nulls first) with its boundaries."""
    if PART in df.columns:
        raise ValueError(f"{PART} names the parts")
    count = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(key).asc_nulls_first()
    spread = free_name(df, "_spread")
    if not df.head(1):  # an empty table has no parts; its columns are kept
        df.withColumn(PART, F.lit(0)).write.mode("overwrite").parquet(f"{path}/rows")
        df.select(F.lit(0).alias(PART), F.lit(0).alias("n_keys"), F.lit(False).alias("has_null"), F.col(key).alias("low"), F.col(key).alias("high")).write.mode(
            "overwrite").parquet(f"{path}/bounds")
        return
    placed = df.withColumn(spread, F.xxhash64(*df.columns)).repartitionByRange(count, order, F.col(spread).asc())
    placed.withColumn(PART, F.spark_partition_id()).drop(spread).sortWithinPartitions(PART, order).write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")
    keys = df.sparkSession.read.parquet(f"{path}/rows").select(PART, F.col(key).alias("k")).distinct()
    bounds = keys.groupBy(PART).agg(F.count(F.lit(1)).alias("n_keys"), F.bool_or(F.col("k").isNull()).alias("has_null"), F.min("k").alias("low"), F.max("k").alias("high"))
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


def _first_ranks(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(part, rank of its first key, rank of its last key), from one small row per part."""
    out, last, last_key, begun = [], 0, None, False
    for r in sorted(spark.read.parquet(f"{path}/bounds").collect(), key=lambda r: r[PART]):
        first_key = None if r["has_null"] else r["low"]
        first = last if begun and first_key == last_key else last + 1     # a key may go on from the part before
        last, last_key, begun = first + r["n_keys"] - 1, r["high"], True
        out.append((r[PART], first, last))
    return out


def read_page(spark: SparkSession, path: str, n1: int, n2: int, key: str, rank_col: str = "dense_rank") -> DataFrame:
    """All rows whose key has dense rank in [n1, n2], with the rank: the rows of ``rank.distinct_key_page``."""
    rows = spark.read.parquet(f"{path}/rows")
    hit = [(part, first) for part, first, last in _first_ranks(spark, path) if first <= n2 and last >= n1]
    if not hit or n2 < n1:
        return rows.drop(PART).withColumn(rank_col, F.lit(None).cast("long")).where(F.lit(False))
    within = Window.partitionBy(PART).orderBy(F.col(key).asc_nulls_first())
    base = F.create_map(*(x for part, first in hit for x in (F.lit(part), F.lit(first - 1).cast("long"))))
    # ranks come from the distinct keys of the page's parts, so no window holds a hot key's rows
    keys = rows.where(F.col(PART).isin([p for p, _ in hit])).select(PART, key).distinct()
    rank = free_name(rows, rank_col)
    ranked = keys.withColumn(rank, F.dense_rank().over(within) + base[F.col(PART)]).where(F.col(rank).between(n1, n2))
    page = rows.where(F.col(PART).isin([p for p, _ in hit])).alias("r")
    same = (F.col(f"r.{PART}") == F.col(f"k.{PART}")) & F.col(f"r.{key}").eqNullSafe(F.col(f"k.{key}"))
    return page.join(ranked.alias("k"), same).select(*(F.col(f"r.{c}") for c in rows.columns if c != PART), F.col(f"k.{rank}").cast("long").alias(rank_col))
