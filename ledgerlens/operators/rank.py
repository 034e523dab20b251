"""Top-1 per group, deterministic dedupe, and distinct-key paging.

``top_per_group`` is ``row_number() <= n`` over a partitioned window; Spark
plans a WindowGroupLimit before the shuffle so each map task
forwards at most ``n`` rows per key and a hot key costs no more than a cold
one. ``cap_by_bits`` caps groups in hash order by a histogram of the hash.

``distinct_key_page`` returns all rows whose key has dense rank in
``[n1, n2]`` (ascending key, nulls first), like
``dense_rank().over(Window.orderBy(key))`` but without moving every row into a
single partition: distinct keys are range-partitioned and sorted, each
partition is numbered locally, per-partition counts become offsets, and only
the keys of the requested page are joined back to the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir

def _order_cols(order) -> list[Column]:
    out = []
    for o in order:
        if isinstance(o, tuple):
            name, direction = o
            c = F.col(name)
            out.append({"asc": c.asc_nulls_first(), "desc": c.desc_nulls_last(),
                        "asc_nulls_last": c.asc_nulls_last(), "desc_nulls_first": c.desc_nulls_first()}[direction])
        else:
            out.append(F.col(o) if isinstance(o, str) else o)
    return out


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores until no column of the frame has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def top_per_group(df: DataFrame, keys, order, n: int = 1, rank_col: str | None = None) -> DataFrame:
    """Rows ranked ``<= n`` by ``order`` within each ``keys`` group.

    ``order`` items: column names (ascending, nulls first), ``(name,
    "asc"|"desc"|"asc_nulls_last"|"desc_nulls_first")`` or sort Columns. It
    must be a total order within a group for a deterministic result; ties are
    otherwise broken arbitrarily, as ``row_number`` does.

    Spark inserts a partial WindowGroupLimit before the shuffle (up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``), so a map task forwards
    at most ``n`` rows of a hot key. Large caps over a hash order belong in
    ``cap_by_bits``, which ranks one narrow hash range only.
    """
    name = rank_col or free_name(df, "__rank")
    w = Window.partitionBy(*keys).orderBy(*_order_cols(order))
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def cap_by_bits(df: DataFrame, group: str, bits: str, tie: str, n: int, width: int, high: int = 12) -> DataFrame:
    """The ``n`` rows of each group with the least ``bits`` (then ``tie``), one plan for every ``n``.

    ``bits`` are ``width`` uniform hash bits. A histogram of their ``high``
    leading bits (at most 2^high rows per group, summed before the shuffle)
    says in which range a group reaches ``n``; rows below it are kept as they
    are, rows above it go, and only that range, about 2^-high of the group, is
    ranked.
    """
    cell, below, count = free_name(df, "__cell"), free_name(df, "__below"), free_name(df, "__count")
    rows = df.withColumn(cell, F.shiftright(F.col(bits), width - high))
    sizes = rows.groupBy(group, cell).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(below, F.coalesce(F.sum(count).over(before), F.lit(0))).where(F.col(below) < n)
    cut = sizes.withColumnsRenamed({group: "__g", cell: "__c"})
    rows = rows.join(cut, rows[group].eqNullSafe(cut["__g"]) & (rows[cell] == cut["__c"])).drop("__g", "__c")
    whole = F.col(below) + F.col(count) <= n
    rank = free_name(df, "__rank")
    edge = rows.where(~whole).withColumn(rank, F.row_number().over(Window.partitionBy(group, cell).orderBy(bits, tie)))
    edge = edge.where(F.col(below) + F.col(rank) <= n).drop(rank)
    return rows.where(whole).unionByName(edge).select(*df.columns)


def dedupe_by_key(df: DataFrame, keys, order=None) -> DataFrame:
    """``dropDuplicates(keys)`` with a defined survivor: the first row by ``order``.

    Without ``order`` all remaining columns (ascending) decide, so the
    survivor is the same on every run.
    """
    if order is None:
        order = [c for c in df.columns if c not in keys]
    return top_per_group(df, keys, order, n=1)


def dense_rank_keys(df: DataFrame, key: str, partitions: int | None = None,
                    rank_col: str = "dense_rank") -> DataFrame:
    """``(key, rank)`` for every distinct key, ranked ascending, nulls first.

    The distinct keys are materialised with a reliable checkpoint (in the
    cluster's ``spark.checkpoint.dir``) so partition ids and local positions
    cannot move between the counting pass and the numbering pass, and a lost
    executor does not force recomputation from the source.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = (df.select(F.col(key).alias("_k")).distinct()
              .repartitionByRange(parts, F.col("_k").asc_nulls_first())
              .sortWithinPartitions(F.col("_k").asc_nulls_first())
              .select("_k", F.spark_partition_id().alias("_pid"),
                      F.monotonically_increasing_id().alias("_mid")))
    keys = keys.select("_k", "_pid", (F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)).alias("_pos"))
    keys = keys.checkpoint(eager=True)
    # One row per partition: the single-partition window below is bounded by
    # the partition count, not by the data.
    counts = keys.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    offsets = offsets.select("_pid", F.coalesce("_off", F.lit(0)).alias("_off"))
    return (keys.join(F.broadcast(offsets), "_pid")
                .select(F.col("_k").alias(key), (F.col("_off") + F.col("_pos") + 1).alias(rank_col)))


def distinct_key_page(df: DataFrame, n1: int, n2: int, key: str = "consumer_id",
                      rank_col: str = "dense_rank", partitions: int | None = None,
                      ranked: DataFrame | None = None) -> DataFrame:
    """All rows whose ``key`` has dense rank in ``[n1, n2]``, with the rank column.

    Same rows and ranks as filtering ``dense_rank().over(Window.orderBy(key))``.
    ``ranked``: the keys as ``dense_rank_keys`` gave them, so that several
    pages rank them once. How the page joins back is left to AQE.
    """
    if n2 < n1:
        return df.withColumn(rank_col, F.lit(None).cast("long")).where(F.lit(False))
    page = ranked if ranked is not None else dense_rank_keys(df, key, partitions, rank_col)
    name = free_name(df, "__page_key")
    page = page.where(F.col(rank_col).between(n1, n2)).withColumnRenamed(key, name)
    return df.join(page, df[key].eqNullSafe(page[name]), "inner").drop(name)
