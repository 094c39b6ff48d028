"""Parquet and CSV tables, bundles and SQL views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def balanced(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of one output folder together, in files of a sensible size.

    Run-time rebalancing splits the folder that holds most of the rows over
    many tasks and merges small ones, so neither one huge task nor a file per
    task and folder results.
    """
    return df.hint("rebalance", *columns) if columns else df


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a table anew."""
    balanced(df, partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write the partitions that ``df`` has rows for anew and leave all others.

    For a corrected release of one year: its rows are staged first and its folder is exchanged
    when all are written, so a failed run leaves the old year and a repeated one changes nothing.
    """
    if not partition_by:
        raise ValueError("name the partition columns")
    balanced(df, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    balanced(df, partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_yearly_csv(df: DataFrame, path: str, year: str = "YEAR") -> None:
    """CSV with a header, one folder per year."""
    balanced(df, [year]).write.mode("overwrite").partitionBy(year).option("header", True).csv(path)


def read_yearly_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read what :func:`write_yearly_csv` wrote; the year returns from the folder name."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_layers(pixels: DataFrame, path: str) -> None:
    """Pixel table with one folder per layer."""
    balanced(pixels, ["layer"]).write.mode("overwrite").partitionBy("layer").parquet(path)


def read_layers(spark: SparkSession, path: str, layers: Sequence[str] | None = None) -> DataFrame:
    """Pixel table; naming layers prunes the other folders."""
    df = spark.read.parquet(path)
    return df if layers is None else df.where(df.layer.isin(*layers))


def save_bundle(tables: Mapping[str, DataFrame], path: str) -> None:
    """A set of named tables under one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run SQL over DataFrames named as views, e.g. ``query(s, "select * from {t}", t=df)``."""
    return spark.sql(sql, **tables)
