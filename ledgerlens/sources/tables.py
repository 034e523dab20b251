"""Readers: parquet tables by name, catalog tables, CSV with a declared schema.

All readers are lazy; nothing is scanned until an action. Column pruning and
filter pushdown are left to Catalyst, so callers should select/filter on the
returned DataFrame rather than pre-reading everything.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


class ParquetTables:
    """Named parquet tables under one directory (``<dir>/<name>.parquet``)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def register_views(self, names=DRIVER_TABLES) -> None:
        for name in names:
            try:
                self(name).createOrReplaceTempView(name)
            except AnalysisException as exc:
                if "PATH_NOT_FOUND" not in str(exc):
                    raise


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Catalog table scan (``spark.table``)."""
    return spark.table(name)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    header: bool = True,
    sep: str = ",",
    names: list[str] | None = None,
) -> DataFrame:
    """CSV read with header and separator.

    A declared ``schema`` avoids the extra full pass that ``inferSchema``
    costs; inference is used only when no schema is given. ``names`` renames
    every column by position, as ``toDF(*names)`` does.
    """
    reader = spark.read.option("header", str(header).lower()).option("sep", sep)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", "true")
    df = reader.csv(path)
    if names:
        df = df.toDF(*names)
    return df


def read_csv_with_rejects(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    header: bool = True,
    sep: str = ",",
    line_col: str = "rejected_line",
) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of a CSV: nothing is lost and nothing is read as null in silence.

    A line is rejected if a value does not parse as its declared type, or if it
    has more or fewer fields than the schema; it is kept whole in ``line_col``.
    Every column is parsed whatever a query selects, so a line is judged alike
    in every query; an empty field is a null and no fault. Both frames are lazy
    scans of the same files.
    """
    declared = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    if line_col in declared.names:
        raise ValueError(f"the schema has a column {line_col} of its own")
    whole = StructType([*declared.fields, StructField(line_col, StringType())])
    rows = (spark.read.schema(whole).option("header", str(header).lower()).option("sep", sep).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", line_col).option("columnPruning", "false").option("enforceSchema", "true").csv(path))
    # nothing of the fields' hash is added to the line, but it needs every field, so the scan parses all of them
    fields = F.xxhash64(*(F.col(f"`{n}`") for n in declared.names)).cast("string")
    rows = rows.withColumn(line_col, F.concat(F.col(line_col), F.substring(fields, 1, 0)))
    return rows.where(F.col(line_col).isNull()).drop(line_col), rows.where(F.col(line_col).isNotNull()).select(line_col)


def read_format(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Path read in a named format (parquet, delta when its jars are present)."""
    return spark.read.format(fmt).load(path)
