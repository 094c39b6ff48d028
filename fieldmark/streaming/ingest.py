"""Incremental ingest of new yearly checklist folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from fieldmark import schemas
from fieldmark.operators.relational import null_safe_join
from fieldmark.sources.checklists import checklist_info, covariates, detections, folder_year
from fieldmark.sources.tables import append_table

KEYS = ["year", "sampling_event_id", "species"]


def checklist_stream(spark: SparkSession, root: str, schema: T.StructType, file: str = "checklists.csv") -> DataFrame:
    """New files of the yearly folders as they arrive, all columns as text."""
    return (
        spark.readStream.schema(schemas.as_text(schema))
        .option("header", True)
        .csv(f"{root}/*/{file}")
        .withColumn("folder_year", folder_year())
    )


def append_new(batch: DataFrame, table: str, keys: Sequence[str] = KEYS) -> None:
    """Append the rows whose key the table does not hold yet.

    The table is partitioned by year, and only the partitions of the batch's
    years are read for the check; the first batch has nothing to check.  A
    batch that is run again after a failure finds its own rows and adds none.
    A missing year (a folder not named by one) is a partition of its own, and
    missing keys match each other.  The batch is read and melted once.
    """
    fresh = batch.dropDuplicates(list(keys)).persist()
    try:
        added = not_held(fresh, table, keys)
        append_table(added.select(*batch.columns), table, ["year"])
    finally:
        fresh.unpersist()


def not_held(fresh: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the year-partitioned table lacks; only the years of the rows are read."""
    known = _existing(fresh.sparkSession, table)
    if known is None:
        return fresh
    years = [r[0] for r in fresh.select("year").distinct().collect()]  # one per folder
    held = F.col("year").isin(*[y for y in years if y is not None])
    held = F.coalesce(held, F.lit(False)) | (F.col("year").isNull() if None in years else F.lit(False))
    return null_safe_join(fresh, known.where(held).select(*keys), list(keys), "left_anti")


def _existing(spark: SparkSession, table: str) -> DataFrame | None:
    try:
        return spark.read.parquet(table)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise


def ingest_available(
    spark: SparkSession,
    root: str,
    species: Sequence[str],
    table: str,
    checkpoint: str,
    schema: T.StructType | None = None,
    file: str = "checklists.csv",
) -> None:
    """Process every folder that has arrived since the last call, then stop.

    ``checkpoint`` and ``table`` must be on storage that the cluster shares.
    """
    stream = checklist_stream(spark, root, schema or schemas.wide_checklist(species), file)
    rows = detections(stream, list(species), ["SAMPLING_EVENT_ID", "folder_year"]).select(
        F.col("folder_year").alias("year"), F.col("SAMPLING_EVENT_ID").alias("sampling_event_id"), "species"
    )
    run = (
        rows.writeStream.foreachBatch(lambda batch, _: append_new(batch, table))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def ingest_info_available(
    spark: SparkSession,
    root: str,
    table: str,
    checkpoint: str,
    covariate_file: DataFrame,
    info: T.StructType = schemas.CHECKLIST_INFO,
    columns: T.StructType | None = None,
    covariate_schema: T.StructType = schemas.CORE_COVARIATES,
    file: str = "checklists.csv",
) -> None:
    """Append the info of new checklists with their covariates, beside the detections.

    ``covariate_file`` is the text table of covariates, joined on the event; a
    checklist without covariates stays, with missing values.  Reruns and
    repeated events add nothing.
    """
    stream = checklist_stream(spark, root, columns or info, file)
    typed = checklist_info(stream, info).withColumn("year", F.col("folder_year")).drop("folder_year")
    clean = covariates(covariate_file, covariate_schema).dropDuplicates(["SAMPLING_EVENT_ID"])
    run = (
        typed.writeStream.foreachBatch(
            lambda batch, _: append_new(batch.join(clean, "SAMPLING_EVENT_ID", "left"), table, ["year", "SAMPLING_EVENT_ID"])
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
