"""Small helpers that several operators share."""

from __future__ import annotations

import functools
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this subpackage, with its SQL where there is one."""

    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = shipped
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return shipped

    return register


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors' Python, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_fieldmark_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="fieldmark-"), "fieldmark.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._fieldmark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that Spark hands to Python at once; bounds memory, never results.
ARROW_BYTES = 2_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark hand rows to Python in batches of ``ARROW_BYTES``, a longer row by itself.

    Spark's own bound of 64 MB is held several times over by the JVM and by each
    Python worker, and neither gives such buffers back.  A bound that the session names stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(ARROW_BYTES))


def vocabulary(path: str) -> bytes:
    """A local vocabulary file of bounded size, read on the driver and sent to tasks with the plan."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 16_000_000:
        raise ValueError(f"{path}: {len(data)} bytes are too many to send to every task")
    return data


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def text_key(text: Column) -> Column:
    """Two 64-bit hashes of a text; with the row's id they stand for the row in joins."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("key"), text, F.length(text)).alias("b"))


#: The part of a hash that orders samples.
LOW_BITS = (1 << 53) - 1


def _within(hash_column: str, rows: int, count: Column | int) -> Column:
    """About four times ``rows`` of ``count`` rows, all if there are no more."""
    share = F.least(F.lit(1.0), F.lit(4.0 * rows) / F.greatest(F.lit(count) if isinstance(count, int) else count, F.lit(1)))
    return F.col(hash_column).bitwiseAND(F.lit(LOW_BITS)) <= share * F.lit(float(LOW_BITS))


def sample_of(df: DataFrame, hash_column: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same at every run: those with the smallest low bits of a hash.

    Rows that cannot be among them are left out first, so that a large table
    does not send so many rows from each of its partitions.
    """
    return df.where(_within(hash_column, rows, df.count())).orderBy(F.col(hash_column).bitwiseAND(F.lit(LOW_BITS)), hash_column).limit(rows)


def sample_of_each(df: DataFrame, key: str, hash_column: str, rows: int) -> DataFrame:
    """As sample_of, for every value of ``key``."""
    sizes = df.groupBy(key).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(key).orderBy(F.col(hash_column).bitwiseAND(F.lit(LOW_BITS)), hash_column)
    few = df.join(sizes, key).where(_within(hash_column, rows, F.col("__n"))).drop("__n")
    return few.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= rows).drop("__r")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once everything that reads it is stored itself."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find plans that are no longer used, so that their shuffle files leave the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def changes(rows: pa.Table | pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Places, counted from 1, where a row's integer ``columns`` differ from those of the row before."""
    if len(rows) < 2:
        return np.zeros(0, np.int64)
    values = [rows.column(c).to_numpy() for c in columns]
    return np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never part rows with equal ``columns``; the input is sorted by these."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= rows:
            whole = pa.Table.from_batches(held)
            cut = changes(whole, columns)
            if len(cut):
                yield whole.slice(0, int(cut[-1]))
                held = whole.slice(int(cut[-1])).to_batches()
                size = sum(map(len, held))
    if size:
        yield pa.Table.from_batches(held)
