"""Survey tables played by the driver's tables, in Spark and in SQL.

Every stand-in reads its source tables whole.  Sites are blocks of 15
neighbouring customers, so their number grows with the data; the season,
protocol and primary-list rules are the checklist filters of the study.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators.pruning import in_season

PROTOCOLS = ("1-URGENT", "2-HIGH", "3-MEDIUM")
YEARS = range(1995, 2002)
CUSTOMERS_PER_SITE = 15
STATE = 7
LAYERS = ("later", "earlier")
PARAMETER_SIZES = {"wp": (7, 2), "betap": (7, 2), "n.occ": (7, 2)}

# --- fixed values: names of the single parameters, by position 42..63 --------
SINGLE_PARAMETERS = (
    "mu.phibeta1", "mu.phibeta2", "mu.phibeta3", "mu.phibeta4", "mu.phibeta5",
    "mu.gammabeta1", "mu.gammabeta2", "mu.gammabeta3", "mu.gammabeta4", "mu.gammabeta5",
    "deviance", "phi.sp.1", "phi.sp.2", "phi.sp.3", "psi.site.0", "phi.site.1", "gamma.site.2",
    "tau.site.eta", "mu.d", "tau.lp", "alpha.t.p", "mu.elev",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- checklists ---------------------------------------------------------------

CHECKLISTS = f"""checklists as (
  select o_orderkey as event_id, o_custkey // {CUSTOMERS_PER_SITE} as site, cast(year(o_orderdate) as int) as year,
    cast(month(o_orderdate) as int) as month, cast(dayofyear(o_orderdate) as int) as day,
    cast(o_orderdate as date) as obs_date, o_orderpriority as count_type,
    case when o_orderstatus = 'P' then 0 else 1 end as primary_flag,
    cast(o_totalprice as decimal(18,2)) as effort,
    cast(25 + (o_custkey % 250) * 0.1 as decimal(12,6)) as raw_latitude,
    cast(-100 + (o_custkey % 300) * 0.1 as decimal(12,6)) as raw_longitude, o_custkey
  from orders)"""

SEASON = """season as (
  select * from checklists where month in (5,6,7) and count_type in ('1-URGENT','2-HIGH','3-MEDIUM') and primary_flag = 1)"""

DETECTIONS = """detections as (
  select distinct l_orderkey as event_id, p_brand as species from lineitem join part on l_partkey = p_partkey)"""

SPECIES_INFO = """species_info as (
  select distinct p_brand as species, case cast(substr(p_brand, 7) as int) % 3
    when 0 then 'Resident' when 1 then 'Neotropical' else 'Temperate' end as mig_status from part)"""


def checklists(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("event_id"),
        F.expr(f"o_custkey div {CUSTOMERS_PER_SITE}").alias("site"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        F.dayofyear("o_orderdate").alias("day"),
        F.to_date("o_orderdate").alias("obs_date"),
        F.col("o_orderpriority").alias("count_type"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("primary_flag"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("effort"),
        F.expr("cast(25 + (o_custkey % 250) * 0.1 as decimal(12,6))").alias("raw_latitude"),
        F.expr("cast(-100 + (o_custkey % 300) * 0.1 as decimal(12,6))").alias("raw_longitude"),
        "o_custkey",
    )


def season(spark: SparkSession, sf: str) -> DataFrame:
    return checklists(spark, sf).where(in_season(protocols=PROTOCOLS, primary=1, flag="primary_flag"))


def records(spark: SparkSession, sf: str, lists: DataFrame | None = None) -> DataFrame:
    """(event_id, species) as recorded, repeats included: for jobs that reduce to sets themselves; with ``lists`` only theirs, cut before species are looked up."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    if lists is not None:
        line = line.join(lists.select(F.col("event_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("event_id"), F.col("p_brand").alias("species")
    )


def detections(spark: SparkSession, sf: str, lists: DataFrame | None = None) -> DataFrame:
    """The detection table without repeats; with ``lists`` only theirs, cut before the repeats are removed."""
    rows = records(spark, sf)
    if lists is not None:
        rows = rows.join(lists.select("event_id"), "event_id", "left_semi")
    return rows.distinct()


def species_info(spark: SparkSession, sf: str) -> DataFrame:
    code = F.substring("p_brand", 7, 10).cast("int") % 3
    status = F.when(code == 0, "Resident").when(code == 1, "Neotropical").otherwise("Temperate")
    return table(spark, sf, "part").select(F.col("p_brand").alias("species"), status.alias("mig_status")).distinct()


def species(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_brand").alias("species")).distinct()


# -- site covariates ----------------------------------------------------------

CLIMATE = """climate as (
  select l_suppkey as site, cast(year(l_shipdate) as int) as year, cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(*) as temp_raw,
    cast(sum(cast(l_discount as decimal(18,4)) * 100) as double) / count(*) as ppt_raw
  from lineitem group by 1, 2),
panel as (
  select site, year, temp_raw / 25.0 - 1.0 as temp, ppt_raw / 5.0 - 1.0 as ppt,
    s_acctbal / 10000.0 as forest, (s_nationkey - 12) / 12.0 as agri, cast(s_nationkey % 5 as double) / 5.0 as urban
  from climate join supplier on site = s_suppkey)"""


def climate_raw(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("site"), F.year("l_shipdate").alias("year"))
        .agg(
            (F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("temp_raw"),
            (F.sum(F.col("l_discount").cast("decimal(18,4)") * 100).cast("double") / F.count("*")).alias("ppt_raw"),
        )
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Site-year covariates: static land cover, yearly temperature and rain."""
    land = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("site"),
        (F.col("s_acctbal") / 10000.0).alias("forest"),
        ((F.col("s_nationkey") - 12) / 12.0).alias("agri"),
        ((F.col("s_nationkey") % 5).cast("double") / 5.0).alias("urban"),
    )
    return climate_raw(spark, sf).select(
        "site", "year", (F.col("temp_raw") / 25.0 - 1.0).alias("temp"), (F.col("ppt_raw") / 5.0 - 1.0).alias("ppt")
    ).join(land, "site")


COEFFICIENTS = """coefs as (
  select p_brand as species, cast(sum(cast(p_retailprice as decimal(18,2))) as double) / count(*) / 1000.0 - 1.0 as a,
    avg(p_size) / 25.0 - 1.0 as b from part group by 1)"""


def coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """Two numbers per species from which the coefficient tables are built."""
    return (
        table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("species"))
        .agg(
            (F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double") / F.count("*") / 1000.0 - 1.0).alias("a"),
            (F.avg("p_size") / 25.0 - 1.0).alias("b"),
        )
    )


# -- pixels -------------------------------------------------------------------

PIXELS = """pixels as (
  select cast(event_id // 100 as int) as prow, cast(event_id % 100 as int) as pcol,
    case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as lc,
    least(cast(floor(value / 25) as int), 4) as lc_before, value
  from events)"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    lc = (
        F.when(F.col("event_type") == "view", 0)
        .when(F.col("event_type") == "click", 1)
        .when(F.col("event_type") == "purchase", 2)
        .when(F.col("event_type") == "signup", 3)
        .otherwise(4)
    )
    return table(spark, sf, "events").select(
        F.expr("cast(event_id div 100 as int)").alias("prow"),
        F.expr("cast(event_id % 100 as int)").alias("pcol"),
        lc.alias("lc"),
        F.least(F.floor(F.col("value") / 25).cast("int"), F.lit(4)).alias("lc_before"),
        "value",
    )


# -- draws --------------------------------------------------------------------


def _sql_names() -> str:
    singles = ", ".join(f"'{n}'" for n in SINGLE_PARAMETERS)
    return f"""case when pos < 14 then 'wp[' || (pos % 7 + 1) || ',' || (pos // 7 + 1) || ']'
      when pos < 28 then 'betap[' || ((pos - 14) % 7 + 1) || ',' || ((pos - 14) // 7 + 1) || ']'
      when pos < 42 then 'n.occ[' || ((pos - 28) % 7 + 1) || ',' || ((pos - 28) // 7 + 1) || ']'
      else list_extract([{singles}], pos - 41) end"""


DRAWS = f"""draws as (
  select vec_id % 3 as chain, vec_id as draw_id, pos, {_sql_names()} as parameter,
    case when pos < 14 then (case when v > 0 then 1.0 else 0.0 end)
      when pos >= 28 and pos < 42 then floor(40 + 100 * v) else v end as value
  from (select vec_id, cast(unnest(embedding) as double) as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings))"""

SUMMARY = """summary as (
  select parameter, avg(value) as mean, stddev_samp(value) as sd, quantile_cont(value, 0.025) as q2_5,
    quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.75) as q75,
    quantile_cont(value, 0.975) as q97_5
  from draws group by 1)"""


def draws(spark: SparkSession, sf: str) -> DataFrame:
    """Long draws; the indicator family is 0/1 and the totals are whole numbers."""
    pos, v = F.col("pos"), F.col("v").cast("double")

    def name(root: str, start: int):
        i = pos - start
        return F.format_string(root + "[%d,%d]", i % 7 + 1, F.floor(i / 7).cast("int") + 1)

    parameter = (
        F.when(pos < 14, name("wp", 0))
        .when(pos < 28, name("betap", 14))
        .when(pos < 42, name("n.occ", 28))
        .otherwise(F.get(F.array(*[F.lit(n) for n in SINGLE_PARAMETERS]), pos - 42))
    )
    value = (
        F.when(pos < 14, F.when(v > 0, 1.0).otherwise(0.0))
        .when((pos >= 28) & (pos < 42), F.floor(40 + 100 * v).cast("double"))
        .otherwise(v)
    )
    return (
        table(spark, sf, "embeddings")
        .select("vec_id", F.posexplode("embedding").alias("pos", "v"))
        .select(
            (F.col("vec_id") % 3).alias("chain"),
            F.col("vec_id").alias("draw_id"),
            "pos",
            parameter.alias("parameter"),
            value.alias("value"),
        )
    )


def sql(*parts: str) -> str:
    """``with`` clause of the named stand-ins followed by the last part."""
    return "with " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
