"""Wide yearly checklist files -> typed info table and long detection table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark import fixed_values as V
from fieldmark import schemas
from fieldmark.functions.columns import presence, sentinel_number, tokens_to_null
from fieldmark.operators.relational import to_long, union_all

# A folder named by the year, or by a partition column and the year.
YEAR_FOLDER = r"/(?:[^/=]+=)?(\d{4})/[^/]*$"


def folder_year(path: Column | str = "_metadata.file_path") -> Column:
    """Year from the name of the folder that holds a file."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, YEAR_FOLDER, 1).try_cast("int")


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line of one CSV file."""
    return spark.read.option("header", True).csv(path).columns


def read_text_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """CSV with a header, every column as text, header names verified."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def scan_checklists(spark: SparkSession, root: str, columns: Sequence[str], file: str = "checklists.csv") -> DataFrame:
    """All yearly folders of ``root`` that hold ``file``, with ``folder_year``.

    The glob skips folders without the file.
    """
    return read_text_csv(spark, f"{root}/*/{file}", columns).withColumn("folder_year", folder_year())


def sample_per_file(df: DataFrame, rows: int, spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """The first ``rows`` rows of each file behind ``df``: a trial-run option.

    There is one file per year, and each limit stops its own scan early.
    """
    return union_all(
        [
            read_text_csv(spark, f, columns).withColumn("folder_year", folder_year()).limit(rows)
            for f in sorted(df.inputFiles())
        ]
    )


def checklist_info(wide: DataFrame, schema: T.StructType = schemas.CHECKLIST_INFO, tokens: Iterable[str] = V.CHECKLIST_MISSING) -> DataFrame:
    """Info columns of a text checklist frame: missing tokens to NULL, then typed."""
    extra = ["folder_year"] if "folder_year" in wide.columns else []
    return wide.select(
        *[tokens_to_null(f.name, tokens).try_cast(f.dataType.simpleString()).alias(f.name) for f in schema.fields],
        *extra,
    )


def covariates(text: DataFrame, schema: T.StructType = schemas.CORE_COVARIATES) -> DataFrame:
    """Covariate columns: tokens and the numeric sentinel to NULL, then typed.

    The columns are those of ``schema``; others are refused, as their sentinels
    would stay.  Release schemas are in :mod:`fieldmark.schemas`.
    """
    unknown = sorted(set(text.columns) - set(schema.names))
    if unknown:
        raise ValueError(f"columns that the covariate schema lacks: {', '.join(unknown)}")
    out = []
    for f in text.columns:
        known = schema[f]
        if isinstance(known.dataType, T.StringType):
            out.append(tokens_to_null(f, V.COVARIATE_MISSING_TEXT).alias(f))
        else:
            out.append(sentinel_number(f).cast(known.dataType.simpleString()).alias(f))
    return text.select(*out)


def long_counts(wide: DataFrame, species: Sequence[str], ids: Sequence[str] = ("SAMPLING_EVENT_ID",)) -> DataFrame:
    """(ids, species, count text): wide species columns to long, missing tokens to NULL."""
    return to_long(wide, ids, species, "species", "count").withColumn(
        "count", tokens_to_null("count", V.CHECKLIST_MISSING)
    )


def detections(wide: DataFrame, species: Sequence[str], ids: Sequence[str] = ("SAMPLING_EVENT_ID",), keep_zeros: bool = False) -> DataFrame:
    """Long detection table; presences only, or all rows with ``pres`` 0/1."""
    rows = long_counts(wide, species, ids).withColumn("pres", presence("count")).drop("count")
    return rows if keep_zeros else rows.where("pres = 1").drop("pres")


def union_yearly(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Many yearly CSVs as one table; without a shared schema columns may differ by year."""
    if schema is not None:
        return spark.read.schema(schema).option("header", True).csv(list(paths))
    return union_all([read_text_csv(spark, p, header_columns(spark, p)) for p in paths])


def read_traits(spark: SparkSession, path: str) -> DataFrame:
    """Species trait list, with the underscored name that checklist columns use."""
    from fieldmark.functions.columns import underscored

    return (
        spark.read.schema(schemas.SPECIES_TRAITS)
        .option("header", True)
        .csv(path)
        .withColumn("species", underscored("scientific_name"))
    )


def with_trait_codes(traits: DataFrame, codes: Mapping[str, int] | None = None) -> DataFrame:
    """Integer code of the migratory status, from a stated map."""
    pairs = dict(codes or V.TRAIT_CODES)
    lookup = F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])
    return traits.withColumn("trait", F.try_element_at(lookup, F.col("mig_status")))


def read_parameter_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PARAMETER_LOOKUP).option("header", True).csv(path)
