"""Lines that are boilerplate of their site (operator 2), by DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import query, stored, table

#: A line goes if more than this share of its site's pages have it, and at least so many pages.
RATIO, LEAST_PAGES = 0.02, 5

#: What a page shows: scripts, styles and comments go, block tags end a line, other tags vanish.
HIDDEN = "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BLOCK = r"(?i)</?(p|br|li|ul|ol|div|h[1-6]|footer|nav|article|section|header|title|head|body|html|main|aside|table|tr|td|th)\b[^>]*>"
TAG = "<[^>]*>"
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def visible_lines(html: Column) -> Column:
    """The lines of a page that show something, without spaces around them, one below the other."""
    parts = F.split(F.regexp_replace(html, HIDDEN, ""), BLOCK)
    lines = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, TAG, "")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def _without(lines: Column, drop: Column) -> Column:
    """``lines`` less the places (from 0) in the ascending array ``drop``: the runs between them."""
    starts = F.concat(F.array(F.lit(0)), F.transform(drop, lambda d: d + 1))
    ends = F.concat(drop, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))


def drop_boilerplate(df: DataFrame, host: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES, lines_column: str = "n_lines", dropped_column: str = "n_dropped") -> DataFrame:
    """Drop the lines of ``text`` that more than ``ratio`` of the host's pages have, ``least_pages`` at least.

    A line is compared without spaces around it; empty lines stay and do not
    count.  A page counts once for a line, and pages of a host with the same text
    count as one, so copies of a page make none of its lines boilerplate.  A null
    host is a host of its own, together with the empty one; a null text stays
    null.  All columns stay, with the text replaced; two counts are added (in place of columns of
    these names).  Hashes of 128 bits stand for lines and texts in the shuffles.
    """
    pages = df.select(
        F.struct("*").alias("__row"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__host"),
        F.col(text).cast("string").alias("__text"),
        F.xxhash64(F.col(text)).alias("__a"),
        F.xxhash64(F.lit("text"), F.col(text), F.length(text)).alias("__b"),
    )
    line = F.trim(F.col("col"))
    lines = pages.where(F.col("__text").isNotNull()).select("__host", "__a", "__b", F.posexplode(F.split("__text", "\n"))).where(line != "")
    lines = lines.select("__host", "__a", "__b", "pos", F.xxhash64(line).alias("__x"), F.xxhash64(F.lit("line"), line).alias("__y"))
    page = F.struct("__a", "__b")
    counts = lines.groupBy("__host", "__x", "__y").agg(F.count_distinct(page).alias("pages")).where(F.col("pages") >= least_pages)
    totals = pages.groupBy("__host").agg(F.count_distinct(page).alias("all_pages"))
    common = counts.join(totals, "__host").where(F.col("pages") > F.lit(ratio) * F.col("all_pages")).select("__host", "__x", "__y")
    # only places of dropped lines move, never the lines
    drops = lines.join(common, ["__host", "__x", "__y"]).groupBy("__host", "__a", "__b").agg(F.sort_array(F.collect_set("pos")).alias("__drop"))
    split = F.split("__text", "\n")
    kept = F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(F.array_join(_without(split, F.col("__drop")), "\n"))
    found = pages.join(drops, ["__host", "__a", "__b"], "left").withColumn("__kept", kept)
    columns = [F.col("__kept").alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in df.columns if c not in (lines_column, dropped_column)]
    shown = F.coalesce(F.size(F.filter(split, lambda x: F.trim(x) != "")), F.lit(0))
    return found.select(
        *columns,
        F.when(F.col("__text").isNull(), 0).otherwise(shown).cast("long").alias(lines_column),
        F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long").alias(dropped_column),
    )


def _sql_text() -> str:
    parts = f"regexp_split_to_array(regexp_replace(html, '{HIDDEN}', '', 'g'), '{BLOCK}')"
    return f"array_to_string(list_filter(list_transform({parts}, lambda s: trim(regexp_replace(s, '{TAG}', '', 'g'))), lambda s: s <> ''), chr(10))"


@query(
    f"""
    with p as (select page_id, coalesce(lower(regexp_extract(url, '{HOST}', 1)), '') as host, {_sql_text()} as body from pages),
    l as (select *, trim(line) as short from (select page_id, host, body, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as pos from p)),
    t as (select host, count(distinct body) as n from p group by host),
    c as (select host, short, count(distinct body) as pages from l where short <> '' group by host, short),
    b as (select host, short, true as hit from c join t using (host) where pages >= {LEAST_PAGES} and pages > {RATIO} * n)
    select page_id, host, coalesce(string_agg(line, chr(10) order by pos) filter (where hit is null), '') as text,
        count(*) filter (where short <> '') as n_lines, count(*) filter (where hit) as n_dropped
    from l left join b using (host, short) group by page_id, host
    """
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), visible_lines(F.col("html")).alias("text"))
    # the operator reads its pages several times: what they show is worked out once
    return drop_boilerplate(stored(pages, "pages"), "host", "text")
