"""Polygon-edge tables: one row per edge, attributes repeated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def edges_from_vertices(vertices: DataFrame, ids: Sequence[str] = ("poly_id", "ring"), order: str = "seq") -> DataFrame:
    """Vertices in order -> edges, closing each ring.

    A window group is one ring.
    """
    w = Window.partitionBy(*ids).orderBy(order)
    whole = Window.partitionBy(*ids).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return vertices.select(
        *ids,
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x2"),
        F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y2"),
    )


def subset_polygons(edges: DataFrame, attribute: str, values: Sequence[object], seasons: Sequence[int] | None = None, season: str = "SEASONAL") -> DataFrame:
    """Edges of the polygons whose attribute is listed (and season, if asked)."""
    keep = F.col(attribute).isin(*values)
    return edges.where(keep if seasons is None else keep & F.col(season).isin(*seasons))


def subset_by_species(edges: DataFrame, species: DataFrame, seasons: Sequence[int], name: str = "SCINAME", season: str = "SEASONAL") -> DataFrame:
    """Range polygons of the study species in the stated seasons."""
    keys = species.select(F.col("scientific_name").alias(name))
    return edges.where(F.col(season).isin(*seasons)).join(keys, name, "left_semi")


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
