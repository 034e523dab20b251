"""Table profiles and descriptive statistics.

``column_stats`` computes every statistic of every chosen column in ONE
global aggregate (partial aggregation per task, a single small merge), then
reshapes that one row to one row per column. Quartiles use
``percentile_approx`` (bounded-memory sketch, as ``DataFrame.summary`` does);
``exact_quantiles`` finds them exactly by distributed selection.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

STATS = ("count", "mean", "stddev", "min", "p25", "p50", "p75", "max")


def summary(df: DataFrame, cols: Sequence[str], stats: Sequence[str] = ()) -> DataFrame:
    """Spark's own ``summary`` (string-typed, long format) restricted to ``cols``."""
    return df.summary(*stats).select("summary", *cols)


def column_stats(df: DataFrame, cols: Sequence[str], accuracy: int = 10000, quantiles: bool = True) -> DataFrame:
    """One row per column: count, mean, stddev, min, p25, p50, p75, max (doubles).

    ``quantiles=False`` skips the sketches (the costliest part) and leaves the
    three quantile columns null.
    """
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        q = (F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy) if quantiles
             else F.lit(None).cast("array<double>"))
        aggs += [
            F.count(x).alias(f"{i}_count"), F.avg(x).alias(f"{i}_mean"), F.stddev_samp(x).alias(f"{i}_stddev"),
            F.min(x).alias(f"{i}_min"), q.alias(f"{i}_q"), F.max(x).alias(f"{i}_max"),
        ]
    one = df.agg(*aggs)
    per_col = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"{i}_count").alias("count"),
                 F.col(f"{i}_mean").alias("mean"), F.col(f"{i}_stddev").alias("stddev"),
                 F.col(f"{i}_min").alias("min"), F.col(f"{i}_q")[0].alias("p25"),
                 F.col(f"{i}_q")[1].alias("p50"), F.col(f"{i}_q")[2].alias("p75"),
                 F.col(f"{i}_max").alias("max"))
        for i, c in enumerate(cols)
    ]
    return one.select(F.explode(F.array(*per_col)).alias("s")).select("s.*")


#: Bits of a value told apart by the first pass of a selection, and by each one after it.
FIRST_BITS, MORE_BITS = 16, 12
_WHOLE = (0, (1 << 64) - 1)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles: all NaN alike and last, minus zero is zero."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = x.view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-1 << 63)).view(np.uint64)


def _value(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


def _histogram(df: DataFrame, cols: Sequence[str], searches: list[tuple[int, int, int]], shift: int) -> dict:
    """(search -> [(bin, rows, least, greatest)]): the values of each search's range by their bits above ``shift``.

    A search is (column number, least key, greatest key). A task sends one row a bin that it meets.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            keys = [_ordered(np.asarray(c.drop_null(), np.float64)) for c in batch.columns]
            for number, (place, low, high) in enumerate(searches):
                k = keys[place]
                k = np.sort(k[(k >= np.uint64(low)) & (k <= np.uint64(high))])
                bins, first, n = np.unique(k >> np.uint64(shift), return_index=True, return_counts=True)
                for b, a, c in zip(bins.tolist(), first.tolist(), n.tolist()):
                    held = found.setdefault((number, b), [0, int(k[a]), int(k[a + c - 1])])
                    held[0] += c
                    held[1], held[2] = min(held[1], int(k[a])), max(held[2], int(k[a + c - 1]))
        # as signed numbers in the same order
        signed = lambda x: x - (1 << 63)
        rows = [(number, signed(b), c, signed(low), signed(high)) for (number, b), (c, low, high) in found.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["search", "bin", "n", "low", "high"])

    near = F.lit(False)
    for place, low, high in searches:
        x = F.col(f"c{place}")
        near = near | (x.isNotNull() if (low, high) == _WHOLE else (x >= F.lit(_value(low))) & (x <= F.lit(_value(high))))
    values = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols))).where(near)
    bins = values.mapInArrow(run, "search long, bin long, n long, low long, high long").groupBy("search", "bin").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[int, list] = {}
    for r in bins.collect():
        out.setdefault(r["search"], []).append((r["bin"] + (1 << 63), r["n"], r["low"] + (1 << 63), r["high"] + (1 << 63)))
    return {k: sorted(v) for k, v in out.items()}


def select_quantiles(df: DataFrame, cols: Sequence[str], at: Sequence[float] = (0.25, 0.5, 0.75)) -> tuple[dict, int]:
    """({(column, point): value}, passes): exact discrete quantiles by selection.

    Doubles are read as whole numbers of the same order. The first pass counts
    the values by their leading bits; the bin in which a point's rank falls is
    counted by more bits in the next, until a bin holds one value. Two or three
    passes do for most columns, five for any. Values are neither sorted nor
    moved: a task sends its bins, and the driver gets at most 2^16 of them a
    column, then 2^12 a column and point. Later passes read the bins' ranges only.
    """
    whole = [(place, *_WHOLE) for place in range(len(cols))]
    shift, passes, done = 64 - FIRST_BITS, 1, {}
    first = _histogram(df, cols, whole, shift)
    ranks = {}                                   # (column, point) -> (rank inside the range, least, greatest)
    pending = []
    for place, bins in first.items():
        total = sum(n for _, n, _, _ in bins)
        for q in at:
            pending.append((place, q, max(-(-_numerator(q) * total // _DENOMINATOR), 1), bins))
    while pending:
        ranks = {}
        for place, q, rank, bins in pending:
            for _, n, low, high in bins:
                if rank <= n:
                    break
                rank -= n
            if low == high:
                done[cols[place], q] = _value(low)
            else:
                ranks[place, q] = (rank, low, high)
        if not ranks:
            break
        shift, passes = max(shift - MORE_BITS, 0), passes + 1
        searches = [(place, low, high) for (place, _), (_, low, high) in ranks.items()]
        found = _histogram(df, cols, searches, shift)
        pending = [(place, q, rank, found[k]) for k, ((place, q), (rank, _, _)) in enumerate(ranks.items())]
    return done, passes


#: Points are taken as fractions of a million, so ranks are whole numbers.
_DENOMINATOR = 1_000_000


def _numerator(q: float) -> int:
    return round(q * _DENOMINATOR)


def exact_quantiles(df: DataFrame, cols: Sequence[str], at: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column_name, p25, p50, p75, ...): the least value whose share of the column's non-null values reaches each point.

    Equal to ``quantile_disc``; NaN is the greatest value. A column without
    values has no row. See ``select_quantiles``.
    """
    found, _ = select_quantiles(df, cols, at)
    rows = [(c, *(found[c, q] for q in at)) for c in cols if (c, at[0]) in found]
    return df.sparkSession.createDataFrame(rows, "column_name string, " + ", ".join(f"p{round(100 * q)} double" for q in at))


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """One row: table name, row count, column count, columns in alphabetical order, and the same with their types."""
    cols = sorted(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows",
        F.lit(len(df.columns)).cast("long").alias("n_cols"),
        F.lit(",".join(cols)).alias("columns_sorted"),
        F.lit(",".join(f"{c} {t}" for c, t in sorted(df.dtypes))).alias("schema_sorted"))


def alphabetical(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def uniqueness_check(df: DataFrame, key: str, where=None) -> DataFrame:
    """Distinct keys next to rows (equal when ``key`` is unique in the slice)."""
    if where is not None:
        df = df.where(where)
    return df.agg(F.count_distinct(key).alias("distinct_keys"), F.count(F.lit(1)).alias("n_rows"))


__all__ = ["summary", "column_stats", "exact_quantiles", "select_quantiles", "table_profile", "alphabetical", "uniqueness_check"]
