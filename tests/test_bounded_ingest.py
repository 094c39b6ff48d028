"""Ingest with state bounded by a watermark."""

from pyspark.sql import functions as F

from fieldmark import fixed_values as V
from fieldmark.streaming import bounded

NAMES = [n for n, _ in V.INFO_COLUMNS_19]


def write(root, year, name, events):
    """(event, year, day) rows; anything else is missing."""
    folder = root / str(year)
    folder.mkdir(parents=True, exist_ok=True)
    rows = [",".join({"SAMPLING_EVENT_ID": e, "YEAR": y, "DAY": d}.get(c, "?") for c in NAMES) for e, y, d in events]
    (folder / f"{name}.csv").write_text("\n".join([",".join(NAMES), *rows]) + "\n")


def test_releases_repeats_late_and_undated_rows(spark, tmp_path):
    root, table, log = tmp_path / "files", str(tmp_path / "table"), str(tmp_path / "log")

    def run():
        progress = bounded.ingest_within_watermark(spark, str(root), table, log, file="*.csv")
        rows = bounded.read_ingested(spark, table).select("year", "SAMPLING_EVENT_ID", "late").collect()
        return sorted((r[0], r[1] or "", r[2]) for r in rows), progress

    for year in range(2004, 2009):
        write(root, year, "first", [(f"E{year}{d}", str(year), str(d)) for d in range(1, 101)] * (2 if year == 2005 else 1))
    first, _ = run()
    assert len(first) == 500 and not any(late for _, _, late in first) and run()[0] == first
    write(root, 2009, "next", [(f"E2009{d}", "2009", str(d)) for d in range(1, 101)])
    write(root, 2008, "again", [(f"E2008{d}", "2008", str(d)) for d in range(1, 151)])  # 100 known, 50 new
    late = [("L1", "2004", "7"), ("L1", "2004", "7"), ("E20045", "2004", "5"), ("U1", "?", "?"), ("?", "2004", "8"), ("?", "2004", "9"), ("B1", "2004", "999")]
    write(root, 2004, "late", late)
    second, progress = run()
    added = [(y, e, lt) for y, e, lt in second if (y, e, lt) not in first]
    assert sorted(r for r in added if r[2]) == [(2004, "", True), (2004, "B1", True), (2004, "L1", True), (2004, "U1", True)]
    assert len([r for r in added if not r[2]]) == 150 and len(second) == 500 + 154
    assert run()[0] == second
    # an event leaves the state 400 days after its day, by a watermark 400 days behind the newest visit (the 100th of 2009): from the 31st of 2007 on
    recent = sum(1 for y, e, lt in second if not lt and (y >= 2008 or (y == 2007 and int(e[5:]) > 31)))
    assert progress["stateOperators"][0]["numRowsTotal"] == recent < len(second)


def test_repeated_rows_under_a_lost_log_of_the_late_part(spark, tmp_path):
    """Rows that are late by now, but were on time when they were stored, are known."""
    root, table = tmp_path / "files", str(tmp_path / "table")
    for year in (2001, 2005):
        write(root, year, "first", [(f"E{d}", str(year), str(d)) for d in range(1, 11)])
    bounded.ingest_within_watermark(spark, str(root), table, str(tmp_path / "log"), file="*.csv")
    write(root, 2001, "again", [(f"E{d}", "2001", str(d)) for d in range(1, 12)])
    bounded.ingest_within_watermark(spark, str(root), table, str(tmp_path / "log"), file="*.csv")
    got = bounded.read_ingested(spark, table).groupBy("year").agg(F.count("*").alias("n"), F.countDistinct("SAMPLING_EVENT_ID").alias("d"))
    assert sorted(map(tuple, got.collect())) == [(2001, 11, 11), (2005, 10, 10)]
