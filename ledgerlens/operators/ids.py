"""Ids of rows whose natural key may repeat, and exact counts of such ids.

Marks of 16 bytes are random, so an exchange of them hardly shrinks. To see
which repeat, 8-byte hashes of them are exchanged: equal marks have equal
hashes, so only marks whose hash repeats are compared whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import surrogate_key
from ..session import ensure_checkpoint_dir, scratch_path
from .rank import free_name

#: Repeated rows whose 16-byte marks are sent to every task; more are joined by an exchange.
MARKED_ROWS = 1_000_000
#: Copies of one row that a task makes at once.
COPIES = 100_000


def numbered_key(df: DataFrame, key_cols, name: str) -> DataFrame:
    """``df`` with a unique id: the natural key, a mark of the whole row, and a number among rows equal in all columns.

    Rows of one key differ in their mark, so an id follows from its own row: a
    late row of the same key changes no other id. Only wholly equal rows need a
    number, 1 to their count, and are interchangeable. The rows are written
    once to the shared checkpoint folder with their 16-byte marks; counting
    reads the marks and exchanges 8-byte hashes of them. Rows whose mark repeats are kept once
    with their count and made again from it, so neither the wide rows nor a
    third of them that are equal pass through one task.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    names = df.columns
    mark, count, number, first, half = (free_name(df, n) for n in ("_mark", "_count", "_number", "_first", "_half"))
    path = scratch_path(spark, "marked-rows")
    df.withColumn(mark, F.unhex(surrogate_key(*(F.col(f"`{c}`") for c in names)))).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    marks = rows.select(mark, F.xxhash64(mark).alias(half))
    halves = marks.groupBy(half).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1).select(half).checkpoint(eager=True)
    if halves.count() <= MARKED_ROWS:
        marks = marks.join(F.broadcast(halves), half, "left_semi")
    again = marks.groupBy(mark).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1).checkpoint(eager=True)

    def with_id(frame, n):
        ident = surrogate_key(*(F.col(f"`{c}`") for c in key_cols), F.lower(F.hex(mark)), n)
        return frame.select(ident.alias(name), *(F.col(f"`{c}`") for c in names))

    repeated = again.count()
    if not repeated:
        return with_id(rows, F.lit(1))
    marked = F.broadcast(again) if repeated <= MARKED_ROWS else again
    once = with_id(rows.join(marked.select(mark), mark, "left_anti"), F.lit(1))
    kept = rows.join(marked.select(mark), mark, "left_semi").groupBy(mark).agg(
        *(F.any_value(F.col(f"`{c}`")).alias(c) for c in names), F.count(F.lit(1)).alias(count))
    runs = kept.withColumn(first, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count), F.lit(COPIES).cast("long")))).repartition(mark, first)
    copies = runs.withColumn(number, F.explode(F.sequence(F.col(first), F.least(F.col(count), F.col(first) + (COPIES - 1)))))
    return once.unionByName(with_id(copies, F.col(number)))


def count_marks(marks: DataFrame, rows: str, distinct: dict[str, str]) -> DataFrame:
    """One row: the number of rows as ``rows``, and of each column the number of distinct values by the name given.

    Equal to ``count_distinct`` of the columns, nulls being no value, with 8
    bytes of each exchanged: a hash that comes once is one value, and only
    values whose hash repeats are counted whole, in a second reading of
    ``marks``. If more than ``MARKED_ROWS`` hashes repeat, all are.
    """
    ensure_checkpoint_dir(marks.sparkSession)
    columns, wide = list(distinct), (len(distinct) - 1).bit_length()
    half, again = ({c: free_name(marks, f"_{n}_{c}") for c in columns} for n in ("half", "again"))

    def hashed(value, i):       # the last bits tell the column
        return F.shiftleft(F.xxhash64(value), wide).bitwiseOR(F.lit(i).cast("long"))

    halved = marks.select(*columns, *(hashed(F.col(c), i).alias(half[c]) for i, c in enumerate(columns)))
    hashes = halved.select(F.explode(F.array(*half.values())).alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    # a null's hash counts as repeated: it is looked at whole, and found to be no value
    null = F.col("hash").isin(*(hashed(F.lit(None).cast(marks.schema[c].dataType), i) for i, c in enumerate(columns)))
    repeated = F.when((F.col("n") > 1) | null, F.col("hash"))
    # one row a repeated hash, and one for all the others of a column
    found = hashes.groupBy(F.col("hash").bitwiseAND(F.lit((1 << wide) - 1).cast("long")).alias("column"), repeated.alias("repeated")).agg(
        F.sum("n").alias("n")).checkpoint(eager=True)
    of = {c: F.col("column") == i for i, c in enumerate(columns)}
    single = F.col("repeated").isNull()
    told = found.agg(F.sum(F.when(of[columns[0]], F.col("n"))).alias("rows"), F.count("repeated").alias("again"),
                     *(F.sum(F.when(of[c] & single, F.col("n"))).alias(half[c]) for c in columns)).first()
    if told["again"] > MARKED_ROWS:
        once, whole = dict.fromkeys(columns, 0), {c: F.col(c) for c in columns}
    else:
        once, whole = {c: told[half[c]] or 0 for c in columns}, {c: F.when(F.col(again[c]), F.col(c)) for c in columns}
        for c in columns:
            halved = halved.join(F.broadcast(found.where(of[c] & ~single).select(F.col("repeated").alias(half[c]), F.lit(True).alias(again[c]))), half[c], "left")
    return halved.select(*(v.alias(c) for c, v in whole.items())).agg(
        F.lit(told["rows"] or 0).cast("long").alias(rows), *((F.count_distinct(c) + once[c]).alias(n) for c, n in distinct.items()))
