"""Joins whose left side has hot keys: found by a frequent-key summary, then salted.

``frequent_keys`` sketches the keys with ``approx_top_k``: each task keeps a
bounded number of counters, the sketches are merged, and every key above a
share of the rows is in the answer, at most a few hundred. ``salted_join`` gives
each of these keys as many salts as its rows need to fill small, even pieces;
the right side's rows of a hot key are repeated for each of its salts, all
other rows join as ever. A wrong count, or two keys with one hash, only change
how rows are dealt, never the result.

Adaptive execution splits a skewed partition while a sort-merge join runs; the
salts work for shuffled hash joins as well, hold for the stages after the join,
and spread null keys, which a left join keeps and matches with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .rank import free_name

#: A key is hot above this share of the rows.
SHARE = 0.002
#: Pieces of a hot key in the space of one average partition: more of them lie more evenly.
PIECES = 8


def _hash(keys: list[str]) -> Column:
    """One number a key; all keys with a null are one."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return F.when(null, F.lit(None).cast("long")).otherwise(F.xxhash64(*keys))


def frequent_keys(df: DataFrame, keys: list[str], share: float = SHARE) -> tuple[int, dict[int | None, int]]:
    """(rows, key hash -> estimated rows) of all keys above ``share`` of the rows; None stands for null keys."""
    tracked = 1 << max(10, int(4 / share).bit_length())
    most = min(tracked, int(1 / share) + 1)
    found = df.select(_hash(keys).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {most}, {tracked})").alias("top")).first()
    return found["n"], {r["item"]: r["count"] for r in found["top"] if r["count"] > share * found["n"]}


def _salts(hashed: Column, counts: dict, rows: int, partitions: int, one_if_null: bool) -> Column:
    pieces = {k: -(-PIECES * n * partitions // rows) for k, n in counts.items()}
    out = F.lit(1)
    known = {k: n for k, n in pieces.items() if k is not None}
    if known:
        table = F.create_map(*(x for k, n in known.items() for x in (F.lit(k).cast("long"), F.lit(n))))
        out = F.coalesce(table[hashed], out)
    if None in pieces and not one_if_null:
        out = F.when(hashed.isNull(), F.lit(pieces[None])).otherwise(out)
    return out


def salted_join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner", spread: list[str] | None = None,
                share: float = SHARE, summary: tuple[int, dict] | None = None) -> DataFrame:
    """``left.join(right, on, how)`` for ``how`` inner or left, with the hot keys of ``left`` spread over tasks.

    ``spread``: columns of the left side that tell the rows of a key apart
    (default: all); the salt is their hash, so a recomputed task deals its rows
    alike. ``summary``: what ``frequent_keys`` said, if it is known. Nulls join
    with nothing, as in a plain join.
    """
    if how not in ("inner", "left"):
        raise ValueError("the right side of a salted join is repeated: inner and left joins only")
    keys = [on] if isinstance(on, str) else list(on)
    rows, counts = summary if summary is not None else frequent_keys(left, keys, share)
    if not counts:
        return left.join(right, keys, how)
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = free_name(right.select(*right.columns, *(F.lit(0).alias(c) for c in left.columns if c not in right.columns)), "_salt")
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(*(spread or left.columns)), _salts(_hash(keys), counts, rows, partitions, False)).cast("int"))
    with_key = right
    for k in keys:
        with_key = with_key.where(F.col(k).isNotNull())
    repeated = with_key.withColumn(salt, F.explode(F.sequence(F.lit(0), (_salts(_hash(keys), counts, rows, partitions, True) - 1).cast("int"))))
    return dealt.join(repeated, [*keys, salt], how).drop(salt)
