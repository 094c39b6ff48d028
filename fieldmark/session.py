"""Session defaults, reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may have before it is no longer broadcast.  Tables that pass are
# aggregates of a few numeric columns, so this stays in the low megabytes.
BROADCAST_ROWS = 50_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "fieldmark") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go once nothing reads them
        .getOrCreate()
    )


def _checkpoint_root(spark: SparkSession) -> str:
    """The folder that holds checkpoints, as the cluster names it.

    Only a local-mode session without the setting gets a folder of its own: a
    machine-local folder would be lost with its executor on a cluster.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return named or os.path.dirname(current)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="fieldmark-")
    sc.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts lineage so that iterations do not grow the plan, and survives the
    loss of executors.
    """
    _checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's full number of partitions.

    For rows that are small in bytes but costly to compute: a stated number is
    not merged into few large partitions at run time.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    return os.path.join(_checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, settled: bool = False) -> DataFrame:
    """Hint a broadcast only when ``df`` is known to be small.

    ``df`` is settled first (unless it is already), so the count does not
    compute it twice.  A larger table comes back without a hint and the join
    shuffles.
    """
    small = df if settled else settle(df)
    return F.broadcast(small) if small.count() <= max_rows else small
