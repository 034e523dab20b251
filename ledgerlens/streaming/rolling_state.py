"""A rolling active-user metric that is maintained: a run adds its rows, it does not read the window again.

The state has one row per group and consumer: the days on which it was active,
as far back as a late row may still touch them. The metric is a running sum of
+1/-1 deltas per group and day (see ``activity``), of which every run writes
its own. A run groups its arrivals by consumer, joins them to the state and
sends the difference between the segments with and without the new days. So it
reads its arrivals and one row per consumer, whatever the length of the window
and the number of rows per consumer and day; repeated rows change nothing.

Late rows are taken in as long as they are at most ``late_days`` older than the
newest day seen; older ones would need days that the state no longer holds and
are returned, not lost. Every run writes folders under its own number and the
state's last, so a run that was lost half way is repeated under that number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import DateLike, date_lit
from ..operators.activity import active_from_deltas, segment_steps


@dataclass(frozen=True)
class RollingState:
    """State and deltas below ``path`` of distinct consumers active in the last ``window_days``, per group and day."""

    path: str
    group_cols: tuple[str, ...]
    window_days: int
    late_days: int = 40
    consumer_col: str = "consumer_id"
    date_col: str = "created_date"

    def runs(self, spark: SparkSession) -> int:
        """The number of finished runs."""
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/*/_SUCCESS")
        found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
        return max((int(str(s.getPath().getParent().getName()).split("=")[1]) for s in found), default=0)

    def _rows(self, df: DataFrame) -> DataFrame:
        rows = df.select(*self.group_cols, F.col(self.consumer_col).alias("_consumer"), F.to_date(self.date_col).alias("_day"))
        return rows.where(F.col("_consumer").isNotNull() & F.col("_day").isNotNull())

    def run(self, arrivals: DataFrame) -> DataFrame:
        """Take in the rows of ``arrivals``; those that come too late are returned as they are.

        Null consumers and dates are ignored, null groups are a group.
        """
        spark, number = arrivals.sparkSession, self.runs(arrivals.sparkSession) + 1
        state = spark.read.parquet(f"{self.path}/state/run={number - 1}") if number > 1 else None
        newest = state.agg(F.max(F.array_max("_days"))).first()[0] if state is not None else None
        day = F.to_date(self.date_col)
        too_late = F.lit(False) if newest is None else day < F.date_sub(F.lit(newest), self.late_days)
        keys = [*self.group_cols, "_consumer"]
        new = self._rows(arrivals.where(~F.coalesce(too_late, F.lit(False)))).groupBy(*keys).agg(F.collect_set("_day").alias("_new"))
        if state is None:
            merged = new.select(*keys, F.array().cast("array<date>").alias("_old"), F.sort_array("_new").alias("_days"))
        else:
            same = F.lit(True)
            for k in keys:
                same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}"))
            none = F.array().cast("array<date>")
            merged = state.alias("s").join(new.alias("n"), same, "full").select(
                *(F.coalesce(f"n.{k}", f"s.{k}").alias(k) for k in keys), F.coalesce("s._days", none).alias("_old"),
                F.sort_array(F.array_union(F.coalesce("s._days", none), F.coalesce("n._new", none))).alias("_days"))
        changed = merged.where(F.size("_days") > F.size("_old"))
        k = self.window_days
        steps = F.concat(segment_steps("_days", k), F.transform(segment_steps("_old", k), lambda e: F.struct(e["day"].alias("day"), (-e["delta"]).alias("delta"))))
        deltas = changed.select(*self.group_cols, F.explode(steps).alias("_e")).groupBy(*self.group_cols, F.col("_e.day").alias("day")).agg(F.sum("_e.delta").alias("delta"))
        deltas.where("delta <> 0").write.mode("overwrite").parquet(f"{self.path}/deltas/run={number}")
        latest = merged.agg(F.max(F.array_max("_days"))).scalar()
        kept = merged.withColumn("_from", F.date_sub(latest, self.late_days + k)).select(
            *keys, F.filter("_days", lambda d: d >= F.col("_from")).alias("_days"))
        kept.where(F.size("_days") > 0).write.mode("overwrite").parquet(f"{self.path}/state/run={number}")
        return arrivals.where(F.coalesce(too_late, F.lit(False)))

    def deltas(self, spark: SparkSession) -> DataFrame:
        """(group, day, delta) of all finished runs: at most one row per run, group and day."""
        paths = [f"{self.path}/deltas/run={n}" for n in range(1, self.runs(spark) + 1)]
        rows = spark.read.parquet(*paths)
        return rows.groupBy(*self.group_cols, "day").agg(F.sum("delta").alias("delta"))

    def metric(self, spark: SparkSession, start: DateLike, as_of: DateLike, kpi: str = "mau") -> DataFrame:
        """The same rows as ``activity.rolling_active_users`` over all arrivals, from the deltas alone."""
        deltas = self.deltas(spark)
        first = deltas.agg(F.min("day")).scalar()
        first_day = F.greatest(date_lit(start), F.date_add(first, self.window_days + 1))
        return active_from_deltas(deltas, list(self.group_cols), first_day, F.date_sub(date_lit(as_of), 1), f"{kpi}_{self.window_days}")
