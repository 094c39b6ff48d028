"""Extraction, pruning, key checks, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.functions import columns as C
from fieldmark.operators import pruning, relational, replicates
from fieldmark.operators.numbering import surrogate_ids
from fieldmark.sources import checklists as files
from fieldmark.sources import tables
from fieldmark.session import scratch_path
from fieldmark.streaming.ingest import ingest_available
from workbook import standins as S
from workbook.registry import query, rounded

WELL_SURVEYED = """reps as (
  select site, year, count(distinct obs_date) as reps from season group by 1, 2),
good_sites as (
  select site, count(*) as n_years from reps where reps >= 3 group by 1 having count(*) >= 3)"""


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS, WELL_SURVEYED,
        "kept as (select * from season where site in (select site from good_sites))",
        """select s.species, y.year, coalesce(occupied, 0) as occupied, surveyed,
          round(coalesce(occupied, 0) / surveyed::double, 6) as naive_psi
        from (select distinct p_brand as species from part) s
          join (select year, count(distinct site) as surveyed from kept group by 1) y on true
          left join (select species, year, count(distinct site) as occupied
            from kept join detections using (event_id) group by 1, 2) d on d.species = s.species and d.year = y.year""",
    )
)
def naive_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    lists = S.season(spark, sf)
    kept = relational.keep_matching(lists, pruning.well_surveyed_sites(lists), "site")
    return rounded(replicates.naive_occupancy(kept, S.records(spark, sf), S.species(spark, sf)), "naive_psi")


@query(
    S.sql(
        S.CHECKLISTS, S.DETECTIONS, S.SPECIES_INFO,
        f"""select event_id, round(raw_latitude, 2)::decimal(9,2) as latitude, round(raw_longitude, 2)::decimal(9,2) as longitude,
          year, month, day, effort, species, make_date(year, 1, 1) + (day - 1)::int as obs_date,
          round(raw_latitude, 2)::decimal(9,2)::varchar || '_' || round(raw_longitude, 2)::decimal(9,2)::varchar as location
        from checklists join detections using (event_id) join species_info using (species)
          join customer on o_custkey = c_custkey
        where mig_status in ('Neotropical', 'Temperate') and c_nationkey = {S.STATE} and year >= 1996
          and month in (5,6,7) and count_type in ('1-URGENT','2-HIGH','3-MEDIUM') and primary_flag = 1""",
    )
)
def season_extract(spark: SparkSession, sf: str) -> DataFrame:
    people = S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("state_province")
    )
    keep = pruning.in_season(protocols=S.PROTOCOLS, primary=1, flag="primary_flag", states=[S.STATE], first_year=1996)
    lists = S.checklists(spark, sf).join(people, "o_custkey").where(keep)
    study = S.species_info(spark, sf).where(F.col("mig_status").isin("Neotropical", "Temperate"))
    return (
        lists.join(S.detections(spark, sf, lists), "event_id")
        .join(study, "species", "left_semi")
        .withColumns(
            {"latitude": C.rounded_coordinate("raw_latitude"), "longitude": C.rounded_coordinate("raw_longitude")}
        )
        .select(
            "event_id", "latitude", "longitude", "year", "month", "day", "effort", "species",
            C.visit_date("year", "day").alias("obs_date"),
            C.place_key("latitude", "longitude").alias("location"),
        )
    )


@query(S.sql(S.CHECKLISTS, S.SEASON, WELL_SURVEYED, "select site, year, reps from reps"))
def site_year_replicates(spark: SparkSession, sf: str) -> DataFrame:
    return pruning.site_year_replicates(S.season(spark, sf))


@query(S.sql(S.CHECKLISTS, S.SEASON, WELL_SURVEYED, "select site, n_years from good_sites"))
def well_surveyed_sites(spark: SparkSession, sf: str) -> DataFrame:
    return pruning.well_surveyed_sites(S.season(spark, sf))


@query(
    S.sql(
        S.CHECKLISTS,
        """select site, count(distinct year) as n_years from checklists group by 1 having count(distinct year) > 2""",
    )
)
def sites_by_years(spark: SparkSession, sf: str) -> DataFrame:
    return pruning.sites_by_years(S.checklists(spark, sf))


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS,
        f"""select species, count(*) as n_records from season join detections using (event_id)
        group by 1 having count(*) >= (select count(*) * 0.15 from season)""",
    )
)
def species_min_records(spark: SparkSession, sf: str) -> DataFrame:
    lists = S.season(spark, sf)
    records = S.detections(spark, sf, lists)
    floor = lists.agg((F.count("*") * F.lit(0.15)).alias("n")).scalar()
    return pruning.species_with_records(records, floor)


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS,
        """select species from detections
        except
        select species from season join detections using (event_id)
        group by 1 having count(*) >= (select count(*) * 0.15 from season)""",
    )
)
def species_lost(spark: SparkSession, sf: str) -> DataFrame:
    return relational.lost_keys(S.records(spark, sf), species_min_records(spark, sf), "species")


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, WELL_SURVEYED,
        """select distinct raw_latitude::decimal(9,2) as latitude, raw_longitude::decimal(9,2) as longitude,
          (o_custkey // 15) in (select site from good_sites) as kept from season""",
    )
)
def sites_before_after(spark: SparkSession, sf: str) -> DataFrame:
    lists = S.season(spark, sf).withColumns(
        {"latitude": C.rounded_coordinate("raw_latitude"), "longitude": C.rounded_coordinate("raw_longitude")}
    )
    good = pruning.well_surveyed_sites(lists).select("site", F.lit(True).alias("kept"))
    return (
        lists.join(good, "site", "left")
        .select("latitude", "longitude", F.coalesce("kept", F.lit(False)).alias("kept"))
        .distinct()
    )


@query("""select l_orderkey, l_partkey, count(*) as n_rows from lineitem group by 1, 2 having count(*) > 1""")
def key_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return relational.duplicate_keys(S.table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS,
        """select event_id, count(*) as n_rows from detections
        where event_id not in (select event_id from season) group by 1""",
    )
)
def key_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return relational.orphan_keys(S.detections(spark, sf), S.season(spark, sf), "event_id")


# -- presence from wide tables ------------------------------------------------

BRANDS = [f"Brand#{i}" for i in range(1, 26)]

COUNT_TEXT = """count_text as (
  select l_orderkey as event_id, p_brand as species, case
    when max(l_returnflag) = 'R' then 'X' when sum(l_quantity) < 8 then '0' when sum(l_quantity) > 60 then '?'
    else cast(cast(sum(l_quantity) as bigint) as varchar) end as n
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""


def wide_counts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per checklist, one text column per species: counts, X, 0, ? or nothing."""
    line, part = S.table(spark, sf, "lineitem"), S.table(spark, sf, "part")
    n = F.sum("l_quantity")
    text = (
        F.when(F.max("l_returnflag") == "R", "X")
        .when(n < 8, "0")
        .when(n > 60, "?")
        .otherwise(n.cast("bigint").cast("string"))
    )
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("SAMPLING_EVENT_ID", F.col("l_orderkey"))
    return relational.to_wide(rows, ["SAMPLING_EVENT_ID"], "p_brand", BRANDS, text)


@query(
    S.sql(
        COUNT_TEXT,
        """select o.event_id as "SAMPLING_EVENT_ID", b.species,
          case when n is null or n in ('?', '0') then 0 else 1 end as pres
        from (select distinct event_id from count_text) o
          join (select distinct p_brand as species from part) b on true
          left join count_text c on c.event_id = o.event_id and c.species = b.species""",
    )
)
def wide_to_long_presence(spark: SparkSession, sf: str) -> DataFrame:
    wide = wide_counts(spark, sf)
    info, species = relational.split_columns(wide, ["SAMPLING_EVENT_ID"])
    return files.detections(wide, species, info, keep_zeros=True)


@query(
    """select c_custkey, c_mktsegment, nullif(c_acctbal, 0) as balance, n_name
    from (select c_custkey, c_mktsegment, c_nationkey, case when c_acctbal < 0 or c_nationkey = 3 then null else c_acctbal end as c_acctbal from customer)
      join nation on c_nationkey = n_nationkey where c_acctbal is not null"""
)
def covariate_sentinels(spark: SparkSession, sf: str) -> DataFrame:
    """Balances written as text with both kinds of missing mark, read back, joined, completed."""
    customer = S.table(spark, sf, "customer")
    text = (
        F.when(F.col("c_acctbal") < 0, "-9999.0000").when(F.col("c_nationkey") == 3, "?").otherwise(F.col("c_acctbal").cast("string"))
    )
    marked = customer.select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"), text.alias("text"))
    read = marked.withColumn("balance", C.sentinel_number("text")).drop("text")
    joined = relational.natural_join(read, S.table(spark, sf, "nation"))
    return relational.complete_rows(joined, ["balance"]).select("c_custkey", "c_mktsegment", "balance", "n_name")


@query(
    S.sql(
        S.CHECKLISTS,
        """select 'n_rows' as dimension, count(*) as n from checklists
        union all select 'sites', count(distinct site) from checklists
        union all select 'years', count(distinct year) from checklists
        union all select 'days', count(distinct obs_date) from checklists""",
    )
)
def dimension_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return pruning.dimension_sizes(S.checklists(spark, sf), sites="site", years="year", days="obs_date")


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON,
        """select min(day) as first_day, max(day) as last_day, min(year - 1994) as first_index, max(year - 1994) as last_index from season""",
    )
)
def day_range(spark: SparkSession, sf: str) -> DataFrame:
    return S.season(spark, sf).agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.min(C.year_index("year", 1995)).alias("first_index"),
        F.max(C.year_index("year", 1995)).alias("last_index"),
    )


# -- ids, names, joins --------------------------------------------------------


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON,
        """select site, row_number() over (order by site) as site_id from (select distinct site from season)""",
    )
)
def site_ids(spark: SparkSession, sf: str) -> DataFrame:
    return surrogate_ids(S.season(spark, sf), "site", "site_id")


@query(
    S.sql(
        S.SPECIES_INFO,
        """select species, mig_status,
          case mig_status when 'Neotropical' then 1 when 'Temperate' then 2 else 3 end as trait from species_info""",
    )
)
def trait_codes(spark: SparkSession, sf: str) -> DataFrame:
    return files.with_trait_codes(S.species_info(spark, sf))


@query(
    """select p_partkey, replace(p_name, ' ', '_') as underscored, replace(replace(p_name, ' ', '_'), '_', ' ') as spaced,
      case when p_size > 25 then 'large' else 'small' end as size_class, cast(p_size as varchar) as size_text,
      cast(p_size > 25 as integer) as is_large, 1 as one from part"""
)
def scalar_names(spark: SparkSession, sf: str) -> DataFrame:
    part = S.table(spark, sf, "part").withColumn("underscored", C.underscored("p_name"))
    named = part.select(
        "p_partkey",
        "underscored",
        C.spaced("underscored").alias("spaced"),
        F.when(F.col("p_size") > 25, "large").otherwise("small").alias("size_class"),
        F.col("p_size").cast("string").alias("size_text"),
        (F.col("p_size") > 25).cast("int").alias("is_large"),
    )
    return relational.with_constants(named, {"one": 1})


@query(
    """select event_type, count(clean) as n_given, count(*) - count(clean) as n_missing, round(avg(clean), 6) as mean
    from (select event_type, case when value < 1 or value > 300 then null else value end as clean from events) group by 1"""
)
def nan_to_null(spark: SparkSession, sf: str) -> DataFrame:
    """NaN and infinity put into a column come out as missing."""
    raw = (
        F.when(F.col("value") < 1, F.lit(float("nan"))).when(F.col("value") > 300, F.lit(float("inf"))).otherwise(F.col("value"))
    )
    clean = S.table(spark, sf, "events").select("event_type", C.finite(raw).alias("clean"))
    return rounded(
        clean.groupBy("event_type").agg(
            F.count("clean").alias("n_given"),
            F.count_if(F.col("clean").isNull()).alias("n_missing"),
            F.avg("clean").alias("mean"),
        ),
        "mean",
    )


@query(
    """with a as (select s_suppkey, case when s_acctbal < 2000 then null else s_nationkey end as k from supplier),
    b as (select n_name, case when n_nationkey = 4 then null else n_nationkey end as k from nation)
    select s_suppkey, a.k, n_name from a join b on a.k is not distinct from b.k"""
)
def null_safe_join(spark: SparkSession, sf: str) -> DataFrame:
    a = S.table(spark, sf, "supplier").select(
        "s_suppkey", F.when(F.col("s_acctbal") >= 2000, F.col("s_nationkey")).alias("k")
    )
    b = S.table(spark, sf, "nation").select(
        "n_name", F.when(F.col("n_nationkey") != 4, F.col("n_nationkey")).alias("k")
    )
    return relational.null_safe_join(a, b)


@query(
    """select 'k' as key_column, count(*) filter (where k is null) as null_rows
    from (select case when s_acctbal < 2000 then null else s_nationkey end as k from supplier)"""
)
def null_key_report(spark: SparkSession, sf: str) -> DataFrame:
    a = S.table(spark, sf, "supplier").select(F.when(F.col("s_acctbal") >= 2000, F.col("s_nationkey")).alias("k"))
    return relational.null_key_report(a, ["k"])


@query("""select c_custkey, c_nationkey, n_name, n_regionkey from customer join nation on c_nationkey = n_nationkey""")
def renamed_key_join(spark: SparkSession, sf: str) -> DataFrame:
    return relational.renamed_join(
        S.table(spark, sf, "customer").select("c_custkey", "c_nationkey"),
        S.table(spark, sf, "nation"),
        "c_nationkey",
        "n_nationkey",
    )


@query(
    """select l_orderkey, n_lines, n_returned from
      (select l_orderkey, count(*) as n_lines from lineitem group by 1)
      join (select l_orderkey, count(*) filter (where l_returnflag = 'R') as n_returned from lineitem group by 1) using (l_orderkey)"""
)
def key_bind(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables bound side by side: on their key, as rows have no position."""
    line = S.table(spark, sf, "lineitem")
    lines = line.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    returned = line.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    return relational.natural_join(lines, returned)


@query(
    """select n_nationkey, n_name, coalesce(cast(null as integer), 0) as absent_count, cast(null as varchar) as absent_text from nation"""
)
def reindex_columns(spark: SparkSession, sf: str) -> DataFrame:
    nation = S.table(spark, sf, "nation")
    wanted = {"n_name": "string", "absent_count": "int", "absent_text": "string"}
    return relational.zero_filled(relational.reindex(nation, wanted, ["n_nationkey"]), ["absent_count"])


# -- files --------------------------------------------------------------------


def _yearly_files(spark: SparkSession, sf: str) -> tuple[str, list[str]]:
    """Checklists and counts written as the yearly wide files that the study reads."""
    root = scratch_path(spark, "yearly")
    info = S.checklists(spark, sf).select(F.col("event_id").alias("SAMPLING_EVENT_ID"), "year", "day", "count_type")
    wide = info.join(wide_counts(spark, sf), "SAMPLING_EVENT_ID")
    by_year = wide.withColumn("folder", F.col("year"))
    tables.balanced(by_year, ["folder"]).write.partitionBy("folder").option("header", True).option("nullValue", "?").csv(root)
    return root, wide.columns


PRESENT_BY_YEAR = S.sql(
    S.CHECKLISTS, COUNT_TEXT,
    """select year, species, count(*) as n_present from checklists join count_text using (event_id)
    where n not in ('?', '0') group by 1, 2""",
)


@query(PRESENT_BY_YEAR)
def union_years(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly wide files written, scanned as one table, melted and counted."""
    root, columns = _yearly_files(spark, sf)
    wide = files.scan_checklists(spark, root, columns, "*.csv")
    long = files.detections(wide, BRANDS, ["SAMPLING_EVENT_ID", "folder_year"])
    return long.groupBy(F.col("folder_year").alias("year"), "species").agg(F.count("*").alias("n_present"))


@query(PRESENT_BY_YEAR)
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The same files through the incremental ingest, run twice: the second run adds nothing."""
    root, columns = _yearly_files(spark, sf)
    target, log = scratch_path(spark, "detections"), scratch_path(spark, "ingest-log")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    for _ in range(2):
        ingest_available(spark, root, BRANDS, target, log, schema, "*.csv")
    return tables.read_table(spark, target).groupBy("year", "species").agg(F.count("*").alias("n_present"))


@query(
    S.sql(
        S.CHECKLISTS, COUNT_TEXT,
        "files as (select year, count(*) as n_rows from checklists where event_id in (select event_id from count_text) group by 1)",
        """given as (select year, species, count(*) as n_present from checklists join count_text using (event_id)
          where n not in ('?', '0') and not (year % 2 = 1 and cast(substr(species, 7) as int) % 3 = 0) group by 1, 2)""",
        """select year, species, n_rows, coalesce(n_present, 0) as n_present
        from files join (select distinct p_brand as species from part) on true left join given using (year, species)""",
    )
)
def union_differing_years(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly files whose columns differ: every third species is missing in odd years and comes back without counts."""
    whole, root = scratch_path(spark, "whole"), scratch_path(spark, "differing")
    info = S.checklists(spark, sf).select(F.col("event_id").alias("SAMPLING_EVENT_ID"), "year")
    info.join(wide_counts(spark, sf), "SAMPLING_EVENT_ID").write.parquet(whole)
    wide = spark.read.parquet(whole)
    absent = [c for c in BRANDS if int(c[6:]) % 3 == 0]
    for year in S.YEARS:
        rows = wide.where(F.col("year") == year)
        (rows.drop(*absent) if year % 2 else rows).write.option("header", True).option("nullValue", "?").csv(f"{root}/{year}")
    back = files.union_yearly(spark, [f"{root}/{y}" for y in S.YEARS])
    long = files.long_counts(back, BRANDS, ["SAMPLING_EVENT_ID", "year"])
    return long.groupBy(F.col("year").cast("int").alias("year"), "species").agg(
        F.count("*").alias("n_rows"), F.count_if(C.presence("count") == 1).alias("n_present")
    )
