"""Replicates, effort, presence, panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions import columns as C
from fieldmark.operators import pruning, relational, replicates
from workbook import standins as S
from workbook.registry import query

VISITS = """visits as (select distinct site, year, obs_date from season),
numbered as (select *, row_number() over (partition by site, year order by obs_date) as replicate from visits)"""

# Columns of the matrix: one for each day of the season, May to July.
WIDTH = 31 + 30 + 31


@query(S.sql(S.CHECKLISTS, S.SEASON, VISITS, "select site, year, obs_date, replicate from numbered"))
def replicate_number(spark: SparkSession, sf: str) -> DataFrame:
    return replicates.replicate_numbers(S.season(spark, sf))


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, VISITS,
        """select site, year, obs_date, row_number() over (partition by site order by obs_date) as replicate from visits""",
    )
)
def replicate_number_all_years(spark: SparkSession, sf: str) -> DataFrame:
    return replicates.replicate_numbers(S.season(spark, sf), across_years=True)


@query(S.sql(S.CHECKLISTS, S.SEASON, VISITS, "select max(replicate) as max_rep from numbered"))
def max_replicates(spark: SparkSession, sf: str) -> DataFrame:
    return pruning.max_replicates(S.season(spark, sf))


def _aggregates() -> dict[str, Column]:
    return {
        "first_day": F.min("day"),
        "effort": F.sum("effort"),
        "mean_day": F.round(F.avg("day"), 6),
        "mean_year": F.round(F.avg("year"), 6),
        "n_lists": F.count("*"),
    }


_AGGREGATES_SQL = """min(day) as first_day, sum(effort) as effort, round(avg(day), 6) as mean_day,
  round(avg(year), 6) as mean_year, count(*) as n_lists"""


@query(S.sql(S.CHECKLISTS, f"select site, obs_date, {_AGGREGATES_SQL} from checklists group by 1, 2"))
def visit_covariates(spark: SparkSession, sf: str) -> DataFrame:
    return replicates.visit_covariates(S.checklists(spark, sf), _aggregates())


@query(
    S.sql(
        S.CHECKLISTS, S.DETECTIONS,
        f"select site, obs_date, {_AGGREGATES_SQL} from checklists join detections using (event_id) group by 1, 2",
    )
)
def visit_covariates_per_species_rows(spark: SparkSession, sf: str) -> DataFrame:
    return replicates.visit_covariates(
        S.checklists(spark, sf), _aggregates(), per_species_rows=S.detections(spark, sf)
    )


FORTNIGHTS = """periods as (
  select *, site + 1 as cell, greatest(0, cast(floor((datediff('day', make_date(year, 5, 1), obs_date) - 1) / 13.0) as int)) as rep
  from season)"""


def periods(spark: SparkSession, sf: str) -> DataFrame:
    return S.season(spark, sf).withColumns({"cell": F.col("site") + 1, "rep": C.fortnight("obs_date")})


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, FORTNIGHTS,
        """select cell, year, rep, count(*) as n_list, sum(effort) as effort, sum(day) as day from periods group by 1, 2, 3""",
    )
)
def fortnight_effort(spark: SparkSession, sf: str) -> DataFrame:
    return replicates.period_effort(periods(spark, sf), ["effort", "day"])


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS, FORTNIGHTS,
        """agg as (select cell, year, rep, count(*) as n_list from periods group by 1, 2, 3)""",
        """select cell, year, rep, species, 1 as detected from periods join detections using (event_id)
        where (cell, year) in (select (cell, year) from agg group by cell, year having count(*) > 2)
        group by 1, 2, 3, 4""",
    )
)
def fortnight_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Species per cell and fortnight, in cell-years with more than two fortnights."""
    lists = periods(spark, sf)
    found = replicates.period_detections(lists, S.records(spark, sf))
    return replicates.keep_replicated(found, replicates.period_effort(lists, []), more_than=2)


DETECTED = """detected as (
  select site, year, c.event_id, p_brand as species, case when max(l_quantity) >= 50 then 1 else 0 end as detected
  from season c join lineitem on l_orderkey = c.event_id join part on l_partkey = p_partkey group by 1, 2, 3, 4)"""


def detected(spark: SparkSession, sf: str) -> DataFrame:
    """Detection rows with a 0/1 value: only a large count is a sure record."""
    line, part = S.table(spark, sf, "lineitem"), S.table(spark, sf, "part")
    lists = S.season(spark, sf).select("event_id", "site", "year")
    return (
        lists.join(line, F.col("event_id") == F.col("l_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("site", "year", "event_id", F.col("p_brand").alias("species"))
        .agg(F.when(F.max("l_quantity") >= 50, 1).otherwise(0).alias("detected"))
    )


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, DETECTED,
        """select * from detected where species in (select species from detected where detected = 1)
          and site in (select site from detected where detected = 1)""",
    )
)
def drop_unseen(spark: SparkSession, sf: str) -> DataFrame:
    return pruning.drop_unseen(detected(spark, sf))


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, DETECTED,
        "peak as (select site, species, max(detected) as m from detected group by 1, 2)",
        """select 'species' as margin, species as name, sum(m) as n_detected from peak group by 2
        union all select 'site', cast(site as varchar), sum(m) from peak group by 2""",
    )
)
def presence_totals(spark: SparkSession, sf: str) -> DataFrame:
    peaks = replicates.presence_peaks(detected(spark, sf))
    by = [
        replicates.peak_totals(peaks, k).select(
            F.lit(k).alias("margin"), F.col(k).cast("string").alias("name"), "n_detected"
        )
        for k in ("species", "site")
    ]
    return relational.union_all(by)


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS,
        """seen as (select distinct site, year, species from season join detections using (event_id))""",
        """select v.site, v.year, s.species, case when d.species is null then 0 else 1 end as z0
        from (select distinct site, year from season) v join (select distinct p_brand as species from part) s on true
          left join seen d on d.site = v.site and d.year = v.year and d.species = s.species""",
    )
)
def naive_z(spark: SparkSession, sf: str) -> DataFrame:
    return replicates.naive_state(S.season(spark, sf), S.records(spark, sf), S.species(spark, sf))


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS,
        """seen as (select distinct site, year, species from season join detections using (event_id)),
        surveyed as (select distinct site, year from season)""",
        """select a.site, y.year::int as year, s.species,
          case when v.site is null then null when d.species is null then 0 else 1 end as z0
        from (select distinct site from season) a join range(1995, 2002) y(year) on true
          join (select distinct p_brand as species from part) s on true
          left join surveyed v on v.site = a.site and v.year = y.year
          left join seen d on d.site = a.site and d.year = y.year and d.species = s.species""",
    )
)
def dense_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The full array: unsurveyed site-years stay missing."""
    lists, species = S.season(spark, sf), S.species(spark, sf)
    grid = replicates.dense_panel(lists, S.YEARS, species)
    known = replicates.naive_state(lists, S.records(spark, sf), species)
    return grid.join(known, ["site", "year", "species"], "left")


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS, VISITS,
        """found as (
          select distinct site, year, species, replicate from season
            join detections using (event_id) join numbered using (site, year, obs_date))""",
        """select v.site, v.year, s.species, """
        + ", ".join(
            f"case when n_rep < {i} then null else max(case when f.replicate = {i} then 1 else 0 end) end as r{i}"
            for i in range(1, WIDTH + 1)
        )
        + """ from (select site, year, max(replicate) as n_rep from numbered group by 1, 2) v
          join (select distinct p_brand as species from part) s on true
          left join found f on f.site = v.site and f.year = v.year and f.species = s.species
        group by v.site, v.year, s.species, n_rep""",
    )
)
def replicate_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return replicates.replicate_matrix(
        S.season(spark, sf), S.records(spark, sf), S.species(spark, sf), WIDTH
    )
