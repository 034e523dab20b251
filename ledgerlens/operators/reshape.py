"""Unpivot (``stack``) and pivot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def unpivot(df: DataFrame, ids: Sequence[str], values: Mapping[str, str] | Sequence[str],
            var_name: str = "key", value_name: str = "value") -> DataFrame:
    """Wide to long: one output row per input row and value column.

    ``values`` is either a list of columns (the label is the column name) or a
    mapping ``label -> column`` (as ``stack(n, 'label', col, ...)``). Null
    values are kept, like ``stack``. Value columns must share a type (cast
    first if they do not).
    """
    pairs = list(values.items()) if isinstance(values, Mapping) else [(c, c) for c in values]
    args: list[Column] = [F.lit(len(pairs))]
    for label, col in pairs:
        args += [F.lit(label), F.col(f"`{col}`")]
    return df.select(*ids, F.stack(*args).alias(var_name, value_name))


def pivot(df: DataFrame, group_cols: Sequence[str], pivot_col: str, agg: Column,
          values: Sequence | None = None, other: str | None = None) -> DataFrame:
    """Long to wide: ``groupBy(group_cols).pivot(pivot_col, values).agg(agg)``.

    Passing ``values`` saves the extra job that collects the distinct pivot
    values and fixes the output columns; without it Spark collects them
    (bounded by ``spark.sql.pivotMaxValues``). ``other`` names a column that
    takes the rows whose value is not listed, so none vanishes; nulls count as
    not listed.
    """
    if other is not None and values is not None:
        names = [str(v) for v in values]
        text = F.col(pivot_col).cast("string")
        df = df.withColumn(pivot_col, F.when(text.isin(names), text).otherwise(F.lit(other)))
        values = [*names, other]
    grouped = df.groupBy(*group_cols)
    grouped = grouped.pivot(pivot_col, list(values)) if values is not None else grouped.pivot(pivot_col)
    return grouped.agg(agg)
