"""Rows that may find a partner in a join, told by a bitmap of the other side's keys.

An equi-join of two large sides exchanges every row of both, also those whose
key the other side does not hold. ``with_partner`` drops most of these before
the exchange: the other side's keys are hashed to places in ``SENT_BITS`` bits,
built with Spark's bitmap functions, and the bits, 16 MB at most, are sent to
every task. A place that two keys share keeps a row too many, never loses one,
so the join that follows gives the same rows. With more keys than bits the
filter keeps nearly all rows and costs its own making.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import ensure_checkpoint_dir
from .rank import free_name

SENT_BITS = 1 << 27


def _place(df: DataFrame, keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*(df[k] for k in keys)), F.lit(SENT_BITS))


def with_partner(rows: DataFrame, keys: list[str], others: DataFrame, other_keys: list[str]) -> DataFrame:
    """``rows`` without those that certainly match no row of ``others`` in an inner or left semi equi-join.

    The keys must be of equal types on both sides. The bits are made at once,
    in a job of their own, and kept in the checkpoint folder: what the join's
    plan sends is ready before its long stages begin.
    """
    kinds = [[df.schema[k].dataType for k in ks] for df, ks in ((rows, keys), (others, other_keys))]
    if kinds[0] != kinds[1]:
        raise ValueError(f"equal keys of different types have different hashes: {kinds[0]}, {kinds[1]}")
    ensure_checkpoint_dir(rows.sparkSession)
    place, block, words = (free_name(rows, n) for n in ("_place", "_block", "_words"))
    held = others.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in other_keys))).select(_place(others, other_keys).alias("place"))
    bits = held.groupBy(F.expr("bitmap_bucket_number(place)").alias(block)).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits"))
    # as 64-bit words, of which a task reads one without copying the block
    word = lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    bits = bits.select(block, F.transform(F.sequence(F.lit(0), F.lit(511)), word).alias(words)).checkpoint(eager=True)
    at = F.expr(f"cast(bitmap_bit_position(`{place}`) as int)")
    byte = F.floor(at / 8)
    bit = F.getbit(F.get(F.col(words), F.floor(at / 64).cast("int")), ((7 - byte % 8) * 8 + at % 8).cast("int"))
    found = rows.withColumn(place, _place(rows, keys)).withColumn(block, F.expr(f"bitmap_bucket_number(`{place}`)"))
    return found.join(F.broadcast(bits), block).where(bit == 1).select(*(F.col(f"`{c}`") for c in rows.columns))
