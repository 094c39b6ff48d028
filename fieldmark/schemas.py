"""Explicit schemas of the input files and tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

from fieldmark import fixed_values as V

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}


def wide_checklist(species: Iterable[str], release: int = 19) -> T.StructType:
    """Info columns typed, every species column as text."""
    info = {19: V.INFO_COLUMNS_19, 17: V.INFO_COLUMNS_17}[release]
    fields = [T.StructField(n, _TYPES[t]) for n, t in info]
    return T.StructType(fields + [T.StructField(s, T.StringType()) for s in species])


def as_text(schema: T.StructType) -> T.StructType:
    """The same columns, all read as text, for files with several missing tokens."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


CHECKLIST_INFO = T.StructType([T.StructField(n, _TYPES[t]) for n, t in V.INFO_COLUMNS_19])
CORE_COVARIATES = T.StructType(
    [T.StructField("SAMPLING_EVENT_ID", T.StringType())]
    + [
        T.StructField(c, T.StringType() if c in V.CORE_TEXT_COVARIATES else T.DoubleType())
        for c in V.CORE_COVARIATES
    ]
)
EXTENDED_COVARIATES = T.StructType(
    [T.StructField("SAMPLING_EVENT_ID", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in V.EXTENDED_COVARIATES]
)
DETECTIONS = T.StructType(
    [T.StructField("sampling_event_id", T.StringType()), T.StructField("species", T.StringType())]
)
DETECTIONS_WITH_PRESENCE = T.StructType(DETECTIONS.fields + [T.StructField("pres", T.IntegerType())])
SPECIES_INFO = T.StructType([T.StructField("species", T.StringType()), T.StructField("family", T.StringType())])
SPECIES_TRAITS = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in ("common_name", "scientific_name", "mig_status", "dietary_guild")
    ]
)
PARAMETER_LOOKUP = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("parameter", "process", "covariate")]
)
PIXELS = T.StructType(
    [
        T.StructField("layer", T.StringType()),
        T.StructField("prow", T.IntegerType()),
        T.StructField("pcol", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)
POLYGON_EDGES = T.StructType(
    [T.StructField("poly_id", T.LongType()), T.StructField("ring", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")]
)
DRAWS = T.StructType(
    [
        T.StructField("chain", T.IntegerType()),
        T.StructField("iteration", T.LongType()),
        T.StructField("parameter", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
SUMMARY = T.StructType(
    [T.StructField("parameter", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("mean", "sd", "q2_5", "q25", "q50", "q75", "q97_5", "rhat")]
)
