"""Loads into a date-partitioned catalog table: new folders, repointed partitions, a journal.

A load writes its rows to a folder that no reader knows. Then the catalog's
partitions are moved: new days are added, rewritten ones are pointed to their
new folder, and last the days of the range that the load did not bring are
dropped from the catalog. Each step is one catalog statement on whole
partitions, so a reader between two steps finds every partition either as it
was or as it will be, never half written, and no file is deleted under a query
that still reads it. ``unreferenced_folders`` names what a later clean-up may remove.

The journal has one row per finished load: the range it covered and the newest
day of the table after it. The next window is planned from the last row, not
from folders: a month that a load emptied, or a load without rows, moves the
window back to the newest day that is left. The row is written last, so a load
that was lost half way is planned again with the same range, and repeating it
gives the same table.

``grain`` is the size of a partition. With months a metric of a few rows a day
makes thirty times fewer folders, and a window is widened to whole months.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import DateLike, to_py_date
from ..sources.sinks import PARTITION_COLUMNS, need_plain_files, with_date_partitions, write_partitioned
from .incremental import IncrementalWindow, first_window

JOURNAL = "load int, first_day date, last_day date, newest_day date, n_rows long, folder string"
#: Partitions named in one catalog statement.
STATEMENT = 500


@dataclass(frozen=True)
class Target:
    """An external table of the catalog; its loads and its journal lie below ``root``."""

    table: str
    root: str
    grain: str = "day"
    fmt: str = "parquet"

    def __post_init__(self):
        need_plain_files(self.fmt)
        if self.grain not in ("day", "month"):
            raise ValueError("grain is day or month")

    @property
    def partition_by(self) -> tuple[str, ...]:
        return PARTITION_COLUMNS if self.grain == "day" else PARTITION_COLUMNS[:2]

    def first_of(self, day: _dt.date) -> _dt.date:
        """The first day of the day's partition."""
        return day if self.grain == "day" else day.replace(day=1)

    def last_of(self, day: _dt.date) -> _dt.date:
        if self.grain == "day":
            return day
        return (day.replace(day=28) + _dt.timedelta(days=4)).replace(day=1) - _dt.timedelta(days=1)


Partition = tuple[str, ...]


def _first_day(values: Partition) -> _dt.date:
    return _dt.date(int(values[0]), int(values[1]), int(values[2]) if len(values) > 2 else 1)


def journal(spark: SparkSession, target: Target) -> DataFrame:
    """One row per finished load, in any order."""
    try:
        return spark.read.schema(JOURNAL).parquet(f"{target.root}/journal")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], JOURNAL)


def last_load(spark: SparkSession, target: Target):
    return journal(spark, target).orderBy(F.desc("load")).first()


def plan_window(spark: SparkSession, target: Target, delta_days: int, buffer_days: int = 0,
                full_load_start: DateLike = "2022-01-01", floor: DateLike | None = None) -> IncrementalWindow:
    """Where the next load starts (A7, A8), from the journal's last row.

    start = newest day - (delta + buffer), not before ``floor``; cut = start +
    buffer. No load so far, or a table that the last load left empty: a full load.
    With month partitions the cut goes back to the first of its month and the
    start with it.
    """
    last = last_load(spark, target)
    if last is None or last["newest_day"] is None:
        return first_window(full_load_start, buffer_days)
    start = last["newest_day"] - _dt.timedelta(days=delta_days + buffer_days)
    if floor is not None:
        start = max(start, to_py_date(floor))
    cut = target.first_of(start + _dt.timedelta(days=buffer_days))
    return IncrementalWindow(True, last["newest_day"], cut - _dt.timedelta(days=buffer_days), cut)


def partitions(spark: SparkSession, target: Target) -> set[Partition]:
    """The partitions that the catalog knows: one short name per day or month."""
    if not spark.catalog.tableExists(target.table):
        return set()
    return {tuple(part.split("=", 1)[1] for part in r[0].split("/")) for r in spark.sql(f"show partitions {target.table}").collect()}


def _written(spark: SparkSession, target: Target, folder: str) -> set[Partition]:
    pattern = spark._jvm.org.apache.hadoop.fs.Path(folder + "".join(f"/{c}=*" for c in target.partition_by))
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    names = (str(s.getPath()).split("/")[-len(target.partition_by):] for s in found)
    return {tuple(n.split("=", 1)[1] for n in name) for name in names}


def swap_statements(target: Target, folder: str, known: set[Partition], written: set[Partition], gone: set[Partition]) -> list[str]:
    """The catalog statements of a swap, in order: add, repoint, and only then drop."""
    def spec(values: Partition) -> str:
        return "partition (" + ", ".join(f"{c}='{v}'" for c, v in zip(target.partition_by, values)) + ")"

    def place(values: Partition) -> str:
        return "location '" + folder + "".join(f"/{c}={v}" for c, v in zip(target.partition_by, values)) + "'"

    def runs(items: set[Partition]):
        ordered = sorted(items)
        return (ordered[i:i + STATEMENT] for i in range(0, len(ordered), STATEMENT))

    out = [f"alter table {target.table} add if not exists " + " ".join(f"{spec(p)} {place(p)}" for p in run) for run in runs(written - known)]
    out += [f"alter table {target.table} {spec(p)} set {place(p)}" for p in sorted(written & known)]
    return out + [f"alter table {target.table} drop if exists " + ", ".join(map(spec, run)) for run in runs(gone)]


def _create(spark: SparkSession, target: Target, df: DataFrame) -> None:
    """The table, if it is missing; else its columns must be those of the frame."""
    if spark.catalog.tableExists(target.table):
        have = {f.name.lower(): f.dataType for f in spark.table(target.table).schema.fields}
        want = {f.name.lower(): f.dataType for f in df.schema.fields}
        if have != want:
            raise ValueError(f"columns of the load {want} are not those of {target.table} {have}")
        return
    plain = [f for f in df.schema.fields if f.name not in target.partition_by]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain)
    spark.sql(f"create table {target.table} ({columns}, {', '.join(f'{c} string' for c in target.partition_by)}) using {target.fmt} "
              f"partitioned by ({', '.join(target.partition_by)}) location '{target.root}/table'")


def load_range(df: DataFrame, target: Target, date_col: str, first: DateLike | None, last: DateLike | None = None,
               writers: int | None = None) -> None:
    """Replace the partitions from ``first`` to ``last`` (None: open) by the frame's rows of these days.

    A range that begins or ends inside a month partition is widened to it, so
    the frame must hold the whole months of its ends. Days of the range without
    rows leave the table. Rows without a date are not loaded.
    """
    spark = df.sparkSession
    low = target.first_of(to_py_date(first)) if first is not None else None
    high = target.last_of(to_py_date(last)) if last is not None else None
    day = F.to_date(date_col)
    rows = df.where(day.isNotNull() if low is None else day >= F.lit(low))
    if high is not None:
        rows = rows.where(day <= F.lit(high))
    rows = with_date_partitions(rows.drop(*PARTITION_COLUMNS), date_col).drop(*(c for c in PARTITION_COLUMNS if c not in target.partition_by))
    _create(spark, target, rows)
    before = last_load(spark, target)
    number = before["load"] + 1 if before is not None else 1
    folder = f"{target.root}/loads/{number:06d}-{uuid.uuid4().hex}"
    write_partitioned(rows, folder, target.partition_by, target.fmt, num_partitions=writers, dynamic=False)
    written, known = _written(spark, target, folder), partitions(spark, target)
    gone = {p for p in known - written if (low is None or low <= _first_day(p)) and (high is None or _first_day(p) <= high)}
    for statement in swap_statements(target, folder, known, written, gone):
        spark.sql(statement)
    left = (known | written) - gone
    newest, n_rows = None, 0
    if left:
        end = max(left, key=_first_day)
        newest = spark.table(target.table).where(_in_partition(target, end)).agg(F.max(F.to_date(date_col))).first()[0]
    if written:
        n_rows = spark.read.format(target.fmt).load(folder).count()
    entry = (number, low, high, newest, n_rows, folder)
    spark.createDataFrame([entry], JOURNAL).coalesce(1).write.mode("append").parquet(f"{target.root}/journal")


def _in_partition(target: Target, values: Partition):
    out = F.lit(True)
    for c, v in zip(target.partition_by, values):
        out = out & (F.col(c) == v)
    return out


def load_window(df: DataFrame, target: Target, date_col: str, window: IncrementalWindow, until: DateLike | None = None,
                writers: int | None = None) -> None:
    """The rows from the window's cut on. A full load replaces every partition."""
    if window.exists:
        load_range(df, target, date_col, window.cut, until, writers)
    else:
        cond = F.col(date_col) >= F.lit(window.cut)
        if until is not None:
            cond = cond & (F.col(date_col) <= F.lit(to_py_date(until)))
        load_range(df.where(cond), target, date_col, None, None, writers)


def unreferenced_folders(spark: SparkSession, target: Target) -> list[str]:
    """Load folders to which no partition points any more; nothing is deleted here."""
    loads = spark._jvm.org.apache.hadoop.fs.Path(f"{target.root}/loads")
    fs = loads.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(loads):
        return []
    names = {str(s.getPath().getName()) for s in fs.listStatus(loads) if s.isDirectory()}
    used = {part for f in spark.table(target.table).inputFiles() for part in f.split("/") if part in names}
    return sorted(f"{target.root}/loads/{n}" for n in names - used)
