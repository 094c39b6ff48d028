"""Incremental ingest whose state is bounded by a watermark on the day of the visit.

Checklists that are newer than the watermark meet only the keys that Spark keeps
for a stated time; older ones, which are few, are compared with the stored
years.  Both kinds have a folder of their own, read together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark import schemas
from fieldmark.sources.checklists import checklist_info
from fieldmark.streaming.ingest import _existing, append_new, checklist_stream, not_held

EVENT = ["year", "SAMPLING_EVENT_ID"]
#: Days behind the newest visit within which a checklist may come again or late: a yearly release and a month.
LATENESS_DAYS = 400


def visit_time(year: Column, day: Column) -> Column:
    """Midnight of the day of a visit, from its year and day of the year; null where one is missing or impossible."""
    known = year.between(1, 9999) & day.between(1, 366)
    return F.when(known, F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1)).cast("timestamp")


def cutoff_seconds(spark: SparkSession, table: str, lateness_days: int = LATENESS_DAYS) -> int:
    """The watermark that the stored visits imply; 0, as Spark's own, before the first of them."""
    known = _existing(spark, f"{table}/on_time")
    newest = known.agg(F.max(F.unix_seconds("visited"))).first()[0] if known is not None else None
    return 0 if newest is None else max(0, newest - lateness_days * 86_400)


def ingest_within_watermark(
    spark: SparkSession,
    root: str,
    table: str,
    checkpoint: str,
    lateness_days: int = LATENESS_DAYS,
    info: T.StructType = schemas.CHECKLIST_INFO,
    columns: T.StructType | None = None,
    file: str = "checklists.csv",
) -> dict | None:
    """Add the checklists of all files that have arrived since the last call, each event of a year once.

    Visits after the watermark pass ``dropDuplicatesWithinWatermark``: its state
    holds events for twice ``lateness_days`` (the watermark lies that far behind the newest visit, and
    an event is forgotten that long after its own day) and no others.  Visits up to
    the watermark, and rows without a date or an event, are late: they are
    compared with the stored rows of their own years and added if these lack
    them, so nothing is lost however late it comes.  Equal events of one file
    set are one row.  A run that is repeated adds nothing.  If the driver ends after the rows
    of a run are stored and before Spark notes that it is done, the events of
    that run are missing in the state: run such a file set again under a new checkpoint and table.
    Returns Spark's progress of the stateful part, None if no file was new.
    """
    cutoff = F.timestamp_seconds(F.lit(cutoff_seconds(spark, table, lateness_days)))
    stream = checklist_stream(spark, root, columns or info, file)
    dated = checklist_info(stream, info).withColumn("visited", visit_time(F.col("YEAR"), F.col("DAY")))
    typed = dated.withColumn("year", F.col("folder_year")).drop("folder_year")
    on_time = F.coalesce((F.col("visited") > cutoff) & F.col("SAMPLING_EVENT_ID").isNotNull(), F.lit(False))
    unique = typed.where(on_time).withWatermark("visited", f"{lateness_days} days").dropDuplicatesWithinWatermark(EVENT)
    new = unique.writeStream.format("parquet").partitionBy("year").option("path", f"{table}/on_time")
    new = new.option("checkpointLocation", f"{checkpoint}/on_time").outputMode("append").trigger(availableNow=True).start()
    new.awaitTermination()

    def add(batch: DataFrame, _: int) -> None:
        append_new(not_held(batch, f"{table}/on_time", EVENT), f"{table}/late", EVENT)

    late = typed.where(~on_time).writeStream.foreachBatch(add)
    late.option("checkpointLocation", f"{checkpoint}/late").trigger(availableNow=True).start().awaitTermination()
    return new.lastProgress


def read_ingested(spark: SparkSession, table: str) -> DataFrame:
    """All stored checklists, with ``late``: whether they came after the watermark had passed them."""
    parts = [(_existing(spark, f"{table}/{name}"), name == "late") for name in ("on_time", "late")]
    found = [rows.withColumn("late", F.lit(late)) for rows, late in parts if rows is not None]
    if not found:
        raise ValueError(f"{table}: nothing was ingested")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])
