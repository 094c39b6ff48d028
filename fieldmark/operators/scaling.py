"""z-scores over a whole column or by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.columns import finite
from fieldmark.operators.relational import null_safe_join
from fieldmark.session import checked_broadcast


def _score(value: Column, mean: Column, sd: Column) -> Column:
    return F.try_divide(value - mean, sd)


def zscore_global(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Add ``(x - mean) / sd`` per column over all rows.

    The statistics are one row and enter as scalar subqueries, so the facts
    are neither joined nor shuffled.  Missing values are left out of the
    statistics; a zero or missing sd gives NULL.
    """
    stats = df.agg(
        F.struct(
            *[F.avg(finite(F.col(c).cast("double"))).alias(f"{c}_m") for c in columns],
            *[F.stddev_samp(finite(F.col(c).cast("double"))).alias(f"{c}_s") for c in columns],
        ).alias("stats")
    ).scalar()
    return df.withColumns(
        {f"{c}{suffix}": _score(finite(F.col(c).cast("double")), stats[f"{c}_m"], stats[f"{c}_s"]) for c in columns}
    )


def zscore_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """z-score within groups (each layer, or each layer and year, on its own).

    The statistics have one row per group; they are broadcast when that is
    small, so that a group holding most of the rows is not moved to one task.
    """
    stats = df.groupBy(*keys).agg(
        *[F.avg(finite(F.col(c).cast("double"))).alias(f"__{c}_m") for c in columns],
        *[F.stddev_samp(finite(F.col(c).cast("double"))).alias(f"__{c}_s") for c in columns],
    )
    # rows without a key are a group of their own
    joined = null_safe_join(df, checked_broadcast(stats), list(keys))
    scored = joined.withColumns(
        {
            f"{c}{suffix}": _score(finite(F.col(c).cast("double")), F.col(f"__{c}_m"), F.col(f"__{c}_s"))
            for c in columns
        }
    )
    return scored.drop(*[f"__{c}_{k}" for c in columns for k in "ms"])
