"""Scans and sinks.

Reads always name their columns so Catalyst prunes the parquet scan to the
projection (``ReadSchema`` lists only what the query needs) and pushes
filters into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan of one table, projected to ``columns``; the files are
    listed anew on every call, so rows added since are read."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """Header CSV; quoted fields may hold commas and quotes.

    A file is split over many tasks. ``multi_line`` also lets quoted fields
    hold newlines, but then each file is read by one task.

    Without a schema every column is read as text (cast later with
    ``try_cast``), the safe choice for untrusted extracts; schema inference
    would cost an extra pass over the data.
    """
    r = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Sink: parquet by default, or header CSV (``fmt='csv'``)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        (w.option("header", True).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.format(fmt).save(path)
