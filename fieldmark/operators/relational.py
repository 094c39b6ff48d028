"""Joins, key checks and column-set changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# -- joins --------------------------------------------------------------------


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    keys = [c for c in a.columns if c in b.columns]
    if not keys:
        raise ValueError("the two tables share no column name")
    return keys


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every shared column name; NULL keys do not match."""
    return a.join(b, shared_columns(a, b), how)


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None, how: str = "inner") -> DataFrame:
    """Natural join in which a missing key matches a missing key."""
    keys = list(keys or shared_columns(a, b))
    right = b.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    match = reduce(lambda x, y: x & y, (a[k].eqNullSafe(right[f"__r_{k}"]) for k in keys))
    return a.join(right, match, how).drop(*[f"__r_{k}" for k in keys])


def renamed_join(a: DataFrame, b: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Join on keys of different names; the left name stays."""
    return a.join(b.withColumnRenamed(right_key, left_key), left_key, how)


def keep_matching(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def drop_matching(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def null_key_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key column that a plain equi-join would lose."""
    counted = df.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in keys])
    return counted.unpivot([], list(keys), "key_column", "null_rows")


# -- key checks ---------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break uniqueness, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def orphan_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child keys without a parent, with their row count.

    The child is aggregated by key before the join, so a hot orphan key costs
    one row there.
    """
    found = child.groupBy(key).agg(F.count("*").alias("n_rows"))
    return found.join(parent.select(key), key, "left_anti")


# -- columns ------------------------------------------------------------------


def split_columns(df: DataFrame, info: Sequence[str]) -> tuple[list[str], list[str]]:
    """Info columns and the rest (one column per species), in file order."""
    return [c for c in df.columns if c in info], [c for c in df.columns if c not in info]


def reindex(df: DataFrame, wanted: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``keep`` plus the wanted columns; absent ones are NULL of the given type."""
    return df.select(
        *keep,
        *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()],
    )


def with_constants(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def zero_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(0, list(columns))


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long; all value columns are read as text so that counts and ``X`` mix."""
    text = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot(list(ids), list(columns), name, value)


def to_wide(
    df: DataFrame, ids: Sequence[str], name: str, values: Sequence[object], value: Column, fill: object = None
) -> DataFrame:
    """Long to wide over a stated list of values (no extra job to find them)."""
    wide = df.groupBy(*ids).pivot(name, list(values)).agg(value)
    return wide if fill is None else wide.na.fill(fill, [str(v) for v in values])


# -- sets ---------------------------------------------------------------------


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_of_filters(df: DataFrame, filters: Sequence[Column]) -> DataFrame:
    """Union of filtered subsets that keeps a row once per filter it passes.

    One scan: each row is repeated by the number of filters it passes.
    """
    passed = reduce(lambda a, b: a + b, (F.coalesce(f.cast("int"), F.lit(0)) for f in filters))
    return df.withColumn("__n", F.explode(F.array_repeat(F.lit(1), passed))).drop("__n")


def lost_keys(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``before`` that ``after`` no longer has."""
    return before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti")


# -- order --------------------------------------------------------------------


def level_rank(c: Column | str, levels: Sequence[str]) -> Column:
    """Position of a value in a stated category order, NULL when it is not a level."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*levels), F.array_position(F.array(*[F.lit(v) for v in levels]), c))


def sorted_by_levels(df: DataFrame, column: str, levels: Sequence[str], *then: str) -> DataFrame:
    return df.orderBy(level_rank(column, levels), *then)
