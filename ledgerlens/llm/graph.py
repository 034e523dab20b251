"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.col("v") % 1000003)).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id on an edge; component is the smallest id reachable.

    ``edges`` has columns u and v (long). Null ends, loops and repeated edges are
    allowed and change nothing; an empty table gives an empty result. The star of
    a hub is joined, never collected, so a skewed join can be split.
    """
    current = cut(edges.where("u is not null and v is not null and u <> v")
                  .select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct())
    mark = _fingerprint(current)
    if not mark[0]:
        return current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        # large star: every larger neighbour of u points to the smallest of u's neighbourhood
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its smaller neighbours point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        current = cut(small)
        new = _fingerprint(current)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
