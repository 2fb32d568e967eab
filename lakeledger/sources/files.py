"""Reading and writing tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "csv", "json", "orc", "avro")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; types are inferred unless a schema spares that extra pass."""
    r = spark.read.option("header", "true")
    return (r.schema(schema) if schema else r.option("inferSchema", "true")).csv(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def write_table(df: DataFrame, name: str, mode: str = "overwrite", partition_by: list[str] | None = None, path: str | None = None) -> None:
    """Save as a catalog table; with ``path`` an external one whose files stay there."""
    w = df.write.mode(mode)
    if path:
        w = w.option("path", path)
    (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(name)


def write_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
