"""Sources and sinks: the driver's tables written, read back and compared with what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark import schemas
from fieldmark.operators import numbering, posterior, relational, replicates
from fieldmark.plans import bundles
from fieldmark.session import scratch_path
from fieldmark.sources import checklists as files
from fieldmark.sources import polygons, tables
from fieldmark.streaming.bounded import ingest_within_watermark, read_ingested
from fieldmark.streaming.ingest import ingest_info_available
from workbook import histories as H
from workbook import standins as S
from workbook.registry import query, rounded

STATUS_ORDER = ("Resident", "Neotropical", "Temperate")


@query(
    S.sql(
        S.SPECIES_INFO,
        """select mig_status, case mig_status when 'Neotropical' then 1 when 'Temperate' then 2 else 3 end as trait,
          count(*) as n, min(replace(species, '#', ' ')) as first_name, max(replace(species, '#', '_')) as last_species
        from species_info group by 1, 2""",
    )
)
def traits_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A trait list as CSV, read with its species names and codes."""
    path = scratch_path(spark, "traits")
    name = F.replace("species", F.lit("#"), F.lit(" "))
    out = S.species_info(spark, sf).select(
        F.lower("species").alias("common_name"), name.alias("scientific_name"), "mig_status", F.lit("Omnivore").alias("dietary_guild")
    )
    out.write.option("header", True).csv(path)
    back = files.with_trait_codes(files.read_traits(spark, path))
    return back.groupBy("mig_status", "trait").agg(
        F.count("*").alias("n"), F.min("scientific_name").alias("first_name"), F.max("species").alias("last_species")
    )


@query(
    S.sql(
        S.SPECIES_INFO,
        "select mig_status as process, count(*) as n, string_agg(species, ' ' order by species) as parameters from species_info group by 1",
    )
)
def lookup_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A parameter lookup as CSV, a parameter for each species."""
    path = scratch_path(spark, "lookup")
    given = S.species_info(spark, sf).select(F.col("species").alias("parameter"), F.col("mig_status").alias("process"), F.lower("species").alias("covariate"))
    given.write.option("header", True).csv(path)
    rows = files.read_parameter_lookup(spark, path)
    names = F.array_join(F.array_sort(F.collect_list("parameter")), " ")
    return rows.groupBy("process").agg(F.count("*").alias("n"), names.alias("parameters"))


@query(
    S.sql(
        S.CHECKLISTS,
        """select year, count(*) as n, sum(event_id)::bigint as ids, sum(effort * 2)::decimal(38,2) as effort from checklists group by 1""",
    )
)
def yearly_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """One CSV folder per year, written twice (the second replaces the first) and read with the year of its folder."""
    path = scratch_path(spark, "yearly-csv")
    rows = S.checklists(spark, sf).select(F.col("year").alias("YEAR"), "event_id", "month", "effort")
    for release in (rows, rows.withColumn("effort", (F.col("effort") * 2).cast("decimal(18,2)"))):
        tables.write_yearly_csv(release, path)
    back = tables.read_yearly_csv(spark, path, T.StructType.fromDDL("event_id long, month int, effort decimal(18,2), YEAR int"))
    return back.groupBy(F.col("YEAR").alias("year")).agg(
        F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.sum("effort").cast("decimal(38,2)").alias("effort")
    )


@query(
    S.sql(
        S.CHECKLISTS, S.DETECTIONS,
        """select year, count(*) as n, count(distinct species) as n_species from checklists join detections using (event_id) group by 1""",
    )
)
def tables_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A table replaced, appended to and asked in SQL."""
    path = scratch_path(spark, "table")
    lists = S.checklists(spark, sf).select("event_id", "year", "month")
    tables.replace_table(lists, path, ["year"])
    tables.replace_table(lists.where("month <= 6"), path, ["year"])
    tables.append_table(lists.where("month > 6"), path, ["year"])
    back = tables.read_table(spark, path, T.StructType.fromDDL("event_id long, month int, year int"))
    return tables.query(
        spark,
        """select year, count(*) as n, count(distinct species) as n_species
        from {lists} join {found} using (event_id) group by year""",
        lists=back,
        found=S.detections(spark, sf),
    )


@query(
    """select 'customer' as name, count(*) as n, sum(c_custkey)::bigint as keys from customer
    union all select 'nation', count(*), sum(n_nationkey)::bigint from nation
    union all select 'region', count(*), sum(r_regionkey)::bigint from region"""
)
def bundle_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Named tables saved under one folder and loaded by name."""
    path = scratch_path(spark, "bundle")
    names = {"customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey"}
    tables.save_bundle({n: S.table(spark, sf, n) for n in names}, path)
    loaded = tables.load_bundle(spark, path, list(names))
    return relational.union_all(
        [df.select(F.lit(n).alias("name"), F.col(names[n]).cast("long").alias("k")).groupBy("name").agg(F.count("*").alias("n"), F.sum("k").alias("keys")) for n, df in loaded.items()]
    )


@query(
    """select event_type as layer, count(*) as n, round(sum(value), 4) as total from events where event_type is not null group by 1"""
)
def layers_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels with one folder per layer, read by the layers' names."""
    path = scratch_path(spark, "layers")
    events = S.table(spark, sf, "events")
    tables.write_layers(events.select(F.col("event_type").alias("layer"), F.col("event_id").alias("pixel"), "value"), path)
    named = [r[0] for r in events.select("event_type").distinct().dropna().collect()]  # a raster's layers are few
    back = tables.read_layers(spark, path, named)
    return rounded(back.groupBy("layer").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", places=4)


@query(
    """with v as (select s_nationkey as poly_id, row_number() over (partition by s_nationkey order by s_suppkey) as seq,
        count(*) over (partition by s_nationkey) as n, s_suppkey as x, s_suppkey % 7 as y from supplier)
    select a.poly_id, count(*) as n_edges, sum(a.x * b.y - b.x * a.y)::bigint as twice_area
    from v a join v b on a.poly_id = b.poly_id and b.seq = a.seq % a.n + 1 group by 1"""
)
def edges_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices to closed rings of edges, written and read."""
    path = scratch_path(spark, "edges")
    vertices = S.table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("long").alias("poly_id"), F.lit(1).alias("ring"), F.col("s_suppkey").alias("seq"),
        F.col("s_suppkey").cast("double").alias("x"), (F.col("s_suppkey") % 7).cast("double").alias("y"),
    )
    polygons.write_edges(polygons.edges_from_vertices(vertices), path)
    back = polygons.read_edges(spark, path)
    area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    return back.groupBy("poly_id").agg(F.count("*").alias("n_edges"), area.cast("long").alias("twice_area"))


@query(
    S.sql(
        S.SPECIES_INFO,
        """select species, mig_status, row_number() over (
          order by case mig_status when 'Resident' then 1 when 'Neotropical' then 2 else 3 end, species) as rank from species_info""",
    )
)
def sorted_by_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted by a stated category order: every row's place in it, numbered by ranges."""
    ranked = numbering.places(S.species_info(spark, sf), [relational.level_rank("mig_status", STATUS_ORDER), "species"], "rank")
    return ranked.select("species", "mig_status", "rank")


@query(
    S.sql(
        S.CHECKLISTS,
        """select year, least(count(*), 10) as n from checklists group by 1""",
    )
)
def first_rows_of_each_file(spark: SparkSession, sf: str) -> DataFrame:
    """The trial option of reading: ten rows of each yearly file."""
    path = scratch_path(spark, "samples")
    rows = S.checklists(spark, sf).select(F.col("event_id").cast("string").alias("SAMPLING_EVENT_ID"), F.col("month").cast("string").alias("MONTH"), "year")
    rows.repartition("year").write.partitionBy("year").option("header", True).csv(path)
    columns = ["SAMPLING_EVENT_ID", "MONTH"]
    scan = files.scan_checklists(spark, path, columns, "*.csv")
    return files.sample_per_file(scan, 10, spark, columns).groupBy(F.col("folder_year").alias("year")).agg(F.count("*").alias("n"))


@query(
    S.sql(
        S.CHECKLISTS,
        """select year, count(*) as n_lists, count(case when event_id % 5 <> 0 and event_id % 3 <> 0 then 1 end) as n_elevation,
          sum(case when event_id % 5 <> 0 and event_id % 3 <> 0 then event_id % 100 end)::double as elevation,
          count(case when event_id % 4 <> 0 then 1 end) as n_hours
        from checklists group by 1""",
    )
)
def ingest_info(spark: SparkSession, sf: str) -> DataFrame:
    """Info of new checklists with their covariates, appended beside the detections; the second run adds nothing."""
    root, target, log = scratch_path(spark, "info-files"), scratch_path(spark, "info"), scratch_path(spark, "info-log")
    lists = S.checklists(spark, sf)
    event = F.col("event_id").cast("string").alias("SAMPLING_EVENT_ID")
    given = {"SAMPLING_EVENT_ID": event, "YEAR": F.col("year"), "MONTH": F.col("month"), "DAY": F.col("day"), "EFFORT_HRS": F.when(F.col("event_id") % 4 == 0, "?").otherwise("1.5")}
    wide = lists.select(*[given.get(f.name, F.lit("?")).alias(f.name) for f in schemas.CHECKLIST_INFO], F.col("year").alias("folder"))
    tables.balanced(wide, ["folder"]).write.partitionBy("folder").option("header", True).csv(root)
    elevation = F.when(F.col("event_id") % 3 == 0, "-9999.0000").otherwise((F.col("event_id") % 100).cast("string"))
    text = lists.where("event_id % 5 <> 0").select(event, elevation.alias("ELEV_GT"), F.lit("-9999").alias("BCR"))
    for _ in range(2):
        ingest_info_available(spark, root, target, log, text, file="*.csv")
    back = tables.read_table(spark, target)
    return back.groupBy("year").agg(
        F.count("*").alias("n_lists"), F.count("ELEV_GT").alias("n_elevation"), F.sum("ELEV_GT").alias("elevation"), F.count("EFFORT_HRS").alias("n_hours")
    )


@query(
    S.sql(
        S.CHECKLISTS,
        """select year, count(*) as n_lists, count(distinct event_id) as n_events,
          count(case when event_id % 7 = 0 and year <= (select max(year) from checklists) - 3 then 1 end) as n_late
        from checklists group by 1""",
    )
)
def ingest_releases(spark: SparkSession, sf: str) -> DataFrame:
    """A release of all years but the last, then one of the last that repeats the year before and brings late lists of early years.

    Repeats add nothing, late lists come in, and a third run finds nothing to do;
    the stream's state holds the events of 800 days at most.
    """
    root, target, log = scratch_path(spark, "releases"), scratch_path(spark, "visits"), scratch_path(spark, "visits-log")
    lists = S.checklists(spark, sf)
    last = lists.agg(F.max("year")).first()[0]
    given = {"SAMPLING_EVENT_ID": F.col("event_id").cast("string"), "YEAR": F.col("year"), "MONTH": F.col("month"), "DAY": F.col("day")}
    withheld = (F.col("event_id") % 7 == 0) & (F.col("year") <= last - 3)
    first = (F.col("year") < last) & ~withheld
    second = (F.col("year") >= last - 1) | withheld | ((F.col("event_id") % 7 == 1) & (F.col("year") <= last - 3))
    for release in (first, second):
        wide = lists.where(release).select(*[given.get(f.name, F.lit("?")).alias(f.name) for f in schemas.CHECKLIST_INFO], F.col("year").alias("folder"))
        tables.balanced(wide, ["folder"]).write.mode("append").partitionBy("folder").option("header", True).csv(root)
        ingest_within_watermark(spark, root, target, log, file="*.csv")
    ingest_within_watermark(spark, root, target, log, file="*.csv")
    late = F.count(F.when(F.col("late"), 1))
    return read_ingested(spark, target).groupBy("year").agg(F.count("*").alias("n_lists"), F.countDistinct("SAMPLING_EVENT_ID").alias("n_events"), late.alias("n_late"))


@query(
    """select event_type as parameter, round(avg(value), 6) as mean, round(quantile_cont(value, 0.025), 6) as q2_5,
      round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.975), 6) as q97_5 from events group by 1"""
)
def large_group_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of groups above a stated size, by the bracketing way that large groups take."""
    rows = S.table(spark, sf, "events").select(F.col("event_type").alias("parameter"), F.col("value").cast("double").alias("value"))
    q = posterior.exact_quantiles(rows, ["parameter"], "value", (0.025, 0.5, 0.975), accuracy=100)
    means = rows.groupBy("parameter").agg(F.avg("value").alias("mean"))
    out = means.join(q, "parameter").select("parameter", "mean", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q2_5", "q50", "q97_5"))])
    return rounded(out, "mean", "q2_5", "q50", "q97_5")


BUNDLE_YEARS = range(1996, 2001)


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS, H.FORTNIGHTS, S.CLIMATE,
        "effort as (select cell, year, rep, count(*) as n_list, sum(effort) as effort from periods group by 1, 2, 3)",
        "enough as (select cell from effort group by 1 having count(distinct year) > 2)",
        """found as (select distinct cell, year, rep, species from periods join detections using (event_id)
          where cell in (select cell from enough))""",
        f"""region as (select cell, forest, agri, urban from (
          select site as cell, any_value(forest) as forest, any_value(agri) as agri, any_value(urban) as urban, count(distinct year) as n
          from panel where agri < 0.5 and year between {BUNDLE_YEARS.start} and {BUNDLE_YEARS.stop - 1} group by 1) where n = {len(BUNDLE_YEARS)})""",
        """static as (select cell, (forest - avg(forest) over ()) / stddev_samp(forest) over () as forest,
          (agri - avg(agri) over ()) / stddev_samp(agri) over () as agri, (urban - avg(urban) over ()) / stddev_samp(urban) over () as urban from region)""",
        """moving as (select site as cell, year, (temp - avg(temp) over y) / stddev_samp(temp) over y as temp, (ppt - avg(ppt) over y) / stddev_samp(ppt) over y as ppt
          from panel where site in (select cell from region) window y as (partition by year))""",
        f"""kept as (select * from effort where cell in (select cell from found) and cell in (select cell from region)
          and year between {BUNDLE_YEARS.start} and {BUNDLE_YEARS.stop - 1})""",
        "sites as (select cell, row_number() over (order by cell) as site from (select distinct cell from kept))",
        f"""select s.site, k.cell, k.year - {BUNDLE_YEARS.start - 1} as year_index, rep, n_list, k.effort, (select count(distinct species) from found) as n_species,
          (select string_agg(species, ' ' order by species) from found f where f.cell = k.cell and f.year = k.year and f.rep = k.rep) as seen,
          round(forest, 6) as forest, round(agri, 6) as agri, round(urban, 6) as urban, round(temp, 6) as temp, round(ppt, 6) as ppt
        from kept k join sites s using (cell) join static using (cell) join moving m on m.cell = k.cell and m.year = k.year""",
    )
)
def model_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """The chain from cell-by-fortnight rows to the tables of a model run, written, loaded and bound by key."""
    lists = H.periods(spark, sf)
    effort = replicates.period_effort(lists, ["effort"])
    found = replicates.period_detections(lists, S.records(spark, sf)).drop("detected")
    panel = S.panel(spark, sf).withColumnRenamed("site", "cell").where("agri < 0.5")
    cells = panel.groupBy("cell").agg(*[F.first(c).alias(c) for c in ("forest", "agri", "urban")])
    path = scratch_path(spark, "model")
    made = bundles.model_bundle(effort, found, cells, panel, BUNDLE_YEARS, ["forest", "agri", "urban"], ["temp", "ppt"])
    tables.save_bundle(made, path)
    b = tables.load_bundle(spark, path, list(made))
    seen = b["detections"].groupBy("site", "year", "rep").agg(F.array_join(F.array_sort(F.collect_set("species")), " ").alias("seen"))
    n_species = b["species"].agg(F.count("*")).scalar()
    rows = b["visits"].join(seen, ["site", "year", "rep"], "left").join(b["sites"], ["site", "cell"]).join(b["site_years"], ["site", "cell", "year"])
    out = rows.select("site", "cell", "year_index", "rep", "n_list", "effort", n_species.alias("n_species"), "seen", "forest", "agri", "urban", "temp", "ppt")
    return rounded(out, "forest", "agri", "urban", "temp", "ppt")


CORRECTED = 1998


@query(
    S.sql(
        S.CHECKLISTS,
        f"""released as (select event_id, year, effort from checklists where year <> {CORRECTED}
          union all select event_id, year, case when event_id % 2 = 0 then effort * 2 else effort end from checklists where year = {CORRECTED} and event_id % 10 <> 0)""",
        "select year, count(*) as n_lists, round(sum(effort)::double, 2) as effort from released group by 1",
    )
)
def corrected_year(spark: SparkSession, sf: str) -> DataFrame:
    """A corrected release of one year replaces that year of the table, twice over, and no other."""
    path = scratch_path(spark, "releases")
    lists = S.checklists(spark, sf).select("event_id", "year", "effort")
    tables.replace_table(lists, path, ["year"])
    fixed = F.when(F.col("event_id") % 2 == 0, F.col("effort") * 2).otherwise(F.col("effort")).cast("decimal(18,2)")
    release = lists.where((F.col("year") == CORRECTED) & (F.col("event_id") % 10 != 0)).withColumn("effort", fixed)
    for _ in range(2):
        tables.replace_partitions(release, path, ["year"])
    back = tables.read_table(spark, path)
    return rounded(back.groupBy("year").agg(F.count("*").alias("n_lists"), F.sum("effort").alias("effort")), "effort", places=2)
