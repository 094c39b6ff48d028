"""Scalar helpers: each takes and returns Columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmark import fixed_values as V

INFINITY = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- missing values -----------------------------------------------------------


def tokens_to_null(c: Column | str, tokens: Iterable[str] = V.CHECKLIST_MISSING) -> Column:
    """Text tokens that mean missing become NULL."""
    c = col(c)
    return F.when(~F.trim(c).isin(*tokens), c)


def sentinel_number(c: Column | str, sentinel: float = V.COVARIATE_MISSING_NUMBER) -> Column:
    """Text to double; the sentinel and anything that is no number become NULL."""
    v = col(c).try_cast("double")
    return finite(F.when(v != sentinel, v))


def finite(c: Column | str) -> Column:
    """NaN and the infinities become NULL: only NULL means missing."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INFINITY)), c)


def presence(c: Column | str) -> Column:
    """1 when a count is given and is not zero (``X`` counts as given), else 0."""
    c = col(c)
    given = c.isNotNull() & (F.coalesce(c.try_cast("double"), F.lit(1.0)) != 0)
    return given.cast("int")


# -- names --------------------------------------------------------------------


def underscored(c: Column | str) -> Column:
    return F.replace(col(c), F.lit(" "), F.lit("_"))


def spaced(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("_"), F.lit(" "))


def indices_of(c: Column | str) -> Column:
    """``betap[7,12]`` -> ``[7, 12]``; a name without indices gives NULL."""
    inside = F.regexp_extract(col(c), r"\[([^\]]*)\]$", 1)
    parts = F.transform(F.split(inside, ","), lambda p: F.trim(p).try_cast("int"))
    return F.when(inside != "", parts)


def root_of(c: Column | str) -> Column:
    """``betap[7,12]`` -> ``betap``."""
    return F.regexp_replace(col(c), r"\[[^\]]*\]$", "")


def index_of(c: Column | str, position: int) -> Column:
    return F.try_element_at(indices_of(c), F.lit(position))


def replaced(c: Column | str, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply regex replacements in order."""
    out = col(c)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def dotted_part(c: Column | str, position: int) -> Column:
    """Part ``position`` (from 1) of a name split on dots, NULL when absent."""
    return F.try_element_at(F.split(col(c), r"\."), F.lit(position))


# -- places and dates ---------------------------------------------------------


def rounded_coordinate(c: Column | str, places: int = 2) -> Column:
    """Half away from zero on exact decimals (binary doubles round unevenly), in one step."""
    return F.round(col(c).cast("decimal(20,14)"), places).cast(f"decimal(9,{places})")


def place_key(lat: Column | str, lon: Column | str) -> Column:
    return F.concat_ws("_", col(lat).cast("string"), col(lon).cast("string"))


def visit_date(year: Column | str, day_of_year: Column | str) -> Column:
    return F.date_add(F.make_date(col(year), F.lit(1), F.lit(1)), col(day_of_year) - 1)


def fortnight(date: Column | str, month: int = V.SEASON_MONTHS[0], spans: tuple[int, ...] = V.FORTNIGHT_DAYS) -> Column:
    """Period number by calendar offset from the season's first day.

    NULL outside the season.  ``spans`` are the period lengths in days.
    """
    date = col(date)
    offset = F.datediff(date, F.make_date(F.year(date), F.lit(month), F.lit(1)))
    out, end = F.when(offset < 0, F.lit(None).cast("int")), 0
    for number, days in enumerate(spans):
        end += days
        out = out.when(offset < end, F.lit(number))
    return out


def year_index(year: Column | str, first: int = 2006) -> Column:
    return col(year) - F.lit(first - 1)


# -- arithmetic ---------------------------------------------------------------


def logit(p: Column | str) -> Column:
    p = col(p)
    return F.ln(p / (1 - p))


def inv_logit(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def percent_of(c: Column | str, total: Column) -> Column:
    return F.try_divide(col(c), total) * 100


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a), col(b))


def bounds(mean: Column | str, sd: Column | str) -> tuple[Column, Column]:
    return col(mean) - col(sd), col(mean) + col(sd)


def important(mean: Column | str, limit: float = V.IMPORTANT_MEAN) -> Column:
    """1 when the mean indicator passes the limit, else NULL, so that a product drops out."""
    return F.when(col(mean) > limit, F.lit(1))
