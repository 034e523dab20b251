"""Dedupe by key over many runs: a run looks at the keys of its window only.

``dropDuplicates`` over the whole history reads all of it for every load. Here a
state table holds, for each key, the order value and the day of the row that
survives so far. It is partitioned by ``bucket``, a function of the key, and
only ever appended to; the least order of a key's rows counts. Beside it lies
a filter table: for each bucket a bitmap of hashed keys in blocks of 32,768
bits, by Spark's bitmap functions.

A run takes the best row of each key in its window and tests the keys against
the bitmaps of their buckets. A key whose bits are not all set was never seen.
Only buckets with a key that may have been seen are read, joined by key, and
only rows that beat what the state holds survive. A late duplicate that beats
a row of an earlier run displaces it; the run reports which row, and on which
day, so that the day can be loaded again. Appended to the state are the keys
that are new or better: work and reads follow the window, not the history. A
bitmap that errs costs the reading of a bucket, never a wrong result.

A window may be run again, after a loss or on purpose: rows that equal the
state's survive, and nothing is appended twice. The result over all runs is
that of one dedupe over the union of the windows. Keys and orders may hold
nulls: null is a value like any other, and the first in order. Rows that tie
in the whole order leave one row a run; make the order total to have one row over all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.rank import free_name, top_per_group
from ..session import ensure_checkpoint_dir

HASHES = 2
#: Bits of filters that are sent to every task; more are joined by an exchange.
SENT_BITS = 1 << 28


@dataclass(frozen=True)
class DedupeState:
    """State below ``path`` for rows keyed by ``keys``; the least ``order`` survives.

    ``buckets``: number of hash buckets. Where keys grow with time, give
    ``bucket_of`` instead, such as ``floor(key / 1e6)``: a window then touches
    few buckets. ``space``: bits of a bucket's filter, about 32 a key.
    """

    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    day: str
    buckets: int = 256
    bucket_of: Column | None = None
    space: int = 1 << 18

    def bucket(self) -> Column:
        own = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)) if self.bucket_of is None else self.bucket_of
        return F.coalesce(own.cast("long"), F.lit(-1).cast("long"))

    def positions(self) -> Column:
        """The key's places in its bucket's bitmap."""
        return F.array(*(F.pmod(F.xxhash64(F.lit(i), *self.keys), F.lit(self.space)) for i in range(HASHES)))

    def _read(self, spark: SparkSession, name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as exc:
            if not any(m in str(exc) for m in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                raise
            return None

    def seen(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame | None:
        """(bucket, _key, keys..., least, day): the surviving order of each key, of some buckets or all; None before the first run.

        ``_key`` is the struct of the keys. Nulls in it are equal, so a join by it is null-safe and needs no second exchange.
        """
        rows = self._read(spark, "seen")
        if rows is None:
            return None
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        best = F.min(F.struct("least", "day"))
        return rows.withColumns({"bucket": F.col("bucket").cast("long"), "_key": F.struct(*self.keys)}).groupBy("bucket", "_key").agg(best.alias("_best")).select(
            "bucket", "_key", *(F.col(f"_key.{k}").alias(k) for k in self.keys), F.col("_best.least").alias("least"), F.col("_best.day").alias("day"))

    def suspects(self, keyed: DataFrame) -> DataFrame | None:
        """The keys of (bucket, keys...) that the filters cannot rule out."""
        filters = self._read(keyed.sparkSession, "filters")
        if filters is None:
            return None
        touched = [r[0] for r in keyed.select("bucket").distinct().collect()]    # at most one number a bucket
        at = keyed.select("bucket", *self.keys, F.posexplode(self.positions()).alias("_hash", "_place"))
        at = at.select("*", F.expr("bitmap_bucket_number(_place)").alias("block"), F.expr("bitmap_bit_position(_place)").alias("_bit"))
        byte = F.conv(F.hex(F.expr("substring(bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
        # or-ed over the runs, a bucket has space / 8 bytes at most: the filters are sent, the keys stay where they are
        merged = filters.where(F.col("bucket").isin(touched)).groupBy("bucket", "block").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
        found = at.join(F.broadcast(merged) if len(touched) * self.space <= SENT_BITS else merged, ["bucket", "block"])
        found = found.where(F.getbit(byte.cast("long"), (F.col("_bit") % 8).cast("int")) == 1)
        return found.groupBy("bucket", *self.keys).agg(F.count_distinct("_hash").alias("_n")).where(F.col("_n") == HASHES).drop("_n")

    def run(self, window: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(survivors, displaced) of one window, and the state brought up to date.

        ``survivors`` has the window's columns: the rows that are the best of
        their key in everything seen so far. ``displaced`` has the keys, the
        order columns and the day of the rows of earlier runs that they beat.
        """
        spark = window.sparkSession
        ensure_checkpoint_dir(spark)
        bucket, least, day = (free_name(window, n) for n in ("bucket_", "least_", "day_"))
        best = top_per_group(window, list(self.keys), list(self.order))
        best = best.withColumns({bucket: self.bucket(), least: F.struct(*self.order), day: F.to_date(self.day)}).checkpoint(eager=True)
        keyed = best.select(F.col(bucket).alias("bucket"), F.struct(*self.keys).alias("_key"), *self.keys, F.col(least).alias("_new"), F.col(day).alias("_new_day"))
        suspects = self.suspects(keyed) if self.seen(spark) is not None else None
        if suspects is None:
            judged = keyed.withColumns({"_old": F.lit(None).cast(keyed.schema["_new"].dataType), "_old_day": F.lit(None).cast("date")})
        else:
            read = [r[0] for r in suspects.select("bucket").distinct().collect()]
            old = self.seen(spark, read).select("bucket", "_key", F.col("least").alias("_old"), F.col("day").alias("_old_day"))
            judged = keyed.drop(*self.keys).join(old, ["bucket", "_key"], "left").select(
                "bucket", *(F.col(f"_key.{k}").alias(k) for k in self.keys), "_new", "_new_day", "_old", "_old_day").checkpoint(eager=True)
        better = judged.where(F.col("_old").isNull() | (F.col("_new") < F.col("_old")))
        added = better.where(F.col("_old").isNull())
        lost = judged.where(F.col("_old").isNotNull() & (F.col("_old") < F.col("_new"))).select(*self.keys, *(F.col(f"_new.{o}").alias(o) for o in self.order))
        # by the columns of without(), which then needs no exchange of the survivors
        survivors = (best if suspects is None else self.without(best, lost)).select(*window.columns)
        displaced = better.where(F.col("_old").isNotNull()).select(*self.keys, *(F.col(f"_old.{o}").alias(o) for o in self.order), F.col("_old_day").alias("day"))
        # filters first: a key in the state whose bits are not set would be missed
        places = added.select("bucket", F.explode(self.positions()).alias("_place"))
        places.groupBy("bucket", F.expr("bitmap_bucket_number(_place)").alias("block")).agg(
            F.expr("bitmap_construct_agg(bitmap_bit_position(_place))").alias("bits")).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/filters")
        better.select("bucket", *self.keys, F.col("_new").alias("least"), F.col("_new_day").alias("day")).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/seen")
        return survivors, displaced

    def without(self, rows: DataFrame, displaced: DataFrame) -> DataFrame:
        """``rows`` of earlier runs without those that a later run displaced."""
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) for c in (*self.keys, *self.order)]
        return rows.alias("r").join(displaced.alias("d"), same, "left_anti")

