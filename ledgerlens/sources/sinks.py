"""Writers: managed table, path, date-partitioned table with dynamic overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PARTITION_COLUMNS = ("year_partition", "month_partition", "day_partition")


def with_date_partitions(df: DataFrame, date_col: str) -> DataFrame:
    """Add zero-padded year/month/day partition strings from a date column."""
    d = F.col(date_col)
    return df.select(
        "*",
        F.date_format(d, "yyyy").alias("year_partition"),
        F.date_format(d, "MM").alias("month_partition"),
        F.date_format(d, "dd").alias("day_partition"),
    )


def write_table(df: DataFrame, name: str, fmt: str = "parquet", mode: str = "overwrite",
                path: str | None = None, partition_by=None) -> None:
    """``saveAsTable``; with ``path`` the table is external."""
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def write_path(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    df.write.format(fmt).mode(mode).save(path)


def _folder(spark, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


#: Formats whose partitions are folders of plain files; a table log (delta and others) names files on its own.
PLAIN_FORMATS = ("parquet", "orc", "avro", "csv", "json", "text")


def need_plain_files(fmt: str) -> None:
    """Refuse formats whose log would not follow a folder that is listed, added or removed behind it."""
    if fmt.lower() not in PLAIN_FORMATS:
        raise ValueError(f"{fmt} tables keep a log of their files; use their own commands to replace days")


def _visible(fs, where) -> list:
    return [s for s in fs.listStatus(where) if not str(s.getPath().getName()).startswith(("_", "."))]


def newest_partition(spark, path: str, partition_by=PARTITION_COLUMNS) -> tuple[str, ...] | None:
    """The values of the newest partition that holds a file; None without one.

    One folder listing per level, walking back over folders that a load emptied.
    Values are compared as numbers, so unpadded ones sort right. No data file is opened.
    """
    fs, where = _folder(spark, path)

    def newest(folder, columns) -> tuple[str, ...] | None:
        if not columns:
            return () if any(s.isFile() for s in _visible(fs, folder)) else None
        names = [str(s.getPath().getName()) for s in _visible(fs, folder) if s.isDirectory()]
        values = [n.split("=", 1)[1] for n in names if n.startswith(f"{columns[0]}=")]
        for value in sorted((v for v in values if v.isdigit()), key=int, reverse=True):
            rest = newest(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{columns[0]}={value}"), columns[1:])
            if rest is not None:
                return (value, *rest)
        return None

    return newest(where, tuple(partition_by)) if fs.exists(where) else None


def drop_days(spark, path: str, days, partition_by=PARTITION_COLUMNS) -> None:
    """Remove the y/M/d partitions of the given days and the month and year folders that this empties; missing ones are skipped."""
    fs, root = _folder(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    for d in days:
        names = (f"{d.year:04d}", f"{d.month:02d}", f"{d.day:02d}")
        folders = [root]
        for c, v in zip(partition_by, names):
            folders.append(path_of(folders[-1], f"{c}={v}"))
        if not fs.exists(folders[-1]):
            continue
        fs.delete(folders[-1], True)
        for parent in folders[-2:0:-1]:
            if list(fs.listStatus(parent)):
                break
            fs.delete(parent, False)


def write_partitioned(df: DataFrame, path: str, partition_by=PARTITION_COLUMNS,
                      fmt: str = "parquet", max_records_per_file: int = 5_000_000,
                      num_partitions: int | None = None, dynamic: bool = True) -> None:
    """Overwrite only the partitions present in ``df``; others stay untouched.

    Default: the ``rebalance`` hint clusters rows by the partition columns so
    each task writes few files per partition, and AQE may split a hot day
    over several tasks (a plain ``repartition`` would put a whole day in one
    task). AQE also merges small rebalanced partitions, so a small frame
    spread over many days ends in one task writing every file; when the
    rows per output partition are known to be bounded (e.g. one row per
    group and day), pass ``num_partitions`` to hash-cluster into exactly that
    many write tasks instead. ``dynamic=False`` replaces the whole table
    (a full load).
    """
    if num_partitions is None:
        clustered = df.hint("rebalance", *partition_by)
    else:
        clustered = df.repartition(num_partitions, *partition_by)
    (clustered.write.format(fmt)
       .mode("overwrite")
       .option("partitionOverwriteMode", "dynamic" if dynamic else "static")
       .option("maxRecordsPerFile", max_records_per_file)
       .partitionBy(*partition_by)
       .save(path))
