"""Files in and out: yearly folders, sentinels, sinks, incremental ingest."""

import pytest
from pyspark.sql import functions as F

from fieldmark import fixed_values as V
from fieldmark import schemas
from fieldmark.sources import checklists as files
from fieldmark.sources import polygons, tables
from fieldmark.streaming.ingest import ingest_available

SPECIES = ["Vireo_griseus", "Aix_sponsa"]
COLUMNS = [n for n, _ in V.INFO_COLUMNS_19] + SPECIES


def line(event, year, counts, lat="40.005", hrs="1.5"):
    info = {"SAMPLING_EVENT_ID": event, "LATITUDE": lat, "LONGITUDE": "-75", "YEAR": str(year), "MONTH": "5", "DAY": "130",
            "COUNT_TYPE": "P21", "EFFORT_HRS": hrs, "PRIMARY_CHECKLIST_FLAG": "1.0"}
    return ",".join([info.get(c, "?") for c, _ in V.INFO_COLUMNS_19] + counts)


def write_year(root, year, lines, name="checklists.csv"):
    folder = root / str(year)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join([",".join(COLUMNS), *lines]) + "\n")


@pytest.fixture
def root(tmp_path):
    write_year(tmp_path, 2006, [line("S1", 2006, ["X", "0"]), line("S2", 2006, ["?", "3"], hrs="?"), line("S3", 2006, ["0", "0"])])
    write_year(tmp_path, 2007, [line("S4", 2007, ["2", "X"])])
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc" / "readme.txt").write_text("not a checklist")
    return tmp_path


def test_scan_types_sentinels_and_folder_year(spark, root):
    wide = files.scan_checklists(spark, str(root), COLUMNS)
    info = {r.SAMPLING_EVENT_ID: r for r in files.checklist_info(wide).collect()}
    assert sorted(info) == ["S1", "S2", "S3", "S4"]
    assert info["S2"].EFFORT_HRS is None and info["S1"].EFFORT_HRS == 1.5
    assert info["S1"].COUNTY is None and info["S4"].folder_year == 2007
    assert files.header_columns(spark, str(root / "2006" / "checklists.csv")) == COLUMNS


def test_wrong_header_is_refused(spark, root):
    swapped = [*COLUMNS[:-2], COLUMNS[-1], COLUMNS[-2]]
    with pytest.raises(Exception, match="header"):
        files.scan_checklists(spark, str(root), swapped).collect()


def test_melt_to_detections(spark, root):
    wide = files.scan_checklists(spark, str(root), COLUMNS)
    got = {tuple(r) for r in files.detections(wide, SPECIES).collect()}
    assert got == {("S1", "Vireo_griseus"), ("S2", "Aix_sponsa"), ("S4", "Vireo_griseus"), ("S4", "Aix_sponsa")}
    kept = files.detections(wide, SPECIES, keep_zeros=True)
    assert kept.count() == 8 and kept.agg(F.sum("pres")).first()[0] == 4


def test_trial_rows_per_file(spark, root):
    wide = files.scan_checklists(spark, str(root), COLUMNS)
    got = files.sample_per_file(wide, 1, spark, COLUMNS).orderBy("SAMPLING_EVENT_ID").collect()
    assert [(r.SAMPLING_EVENT_ID, r.folder_year) for r in got] == [("S1", 2006), ("S4", 2007)]


def test_covariate_file(spark, tmp_path):
    path = tmp_path / "core-covariates.csv"
    path.write_text("SAMPLING_EVENT_ID,POP00_SQMI,BAILEY_ECOREGION\nS1,-9999.0000,M221\nS2,12.5,?\nS3,?,212\n")
    text = files.read_text_csv(spark, str(path), ["SAMPLING_EVENT_ID", "POP00_SQMI", "BAILEY_ECOREGION"])
    got = [tuple(r) for r in files.covariates(text).orderBy("SAMPLING_EVENT_ID").collect()]
    assert got == [("S1", None, "M221"), ("S2", 12.5, None), ("S3", None, "212")]
    assert len(schemas.CORE_COVARIATES) == 62


def test_release_with_17_info_columns():
    assert len(schemas.wide_checklist(SPECIES, 17)) == 17 + 2 and len(schemas.wide_checklist(SPECIES)) == 19 + 2


def test_traits_and_lookup_files(spark, tmp_path):
    (tmp_path / "birds.csv").write_text(
        "common_name,scientific_name,mig_status,dietary_guild\nWood Duck,Aix sponsa,Temperate,PlantSeed\n"
    )
    row = files.with_trait_codes(files.read_traits(spark, str(tmp_path / "birds.csv"))).first()
    assert (row.species, row.trait) == ("Aix_sponsa", 2)
    (tmp_path / "lookup.csv").write_text("parameter,process,covariate\nmu.phibeta1,Persistence,Forest (% cover)\n")
    assert files.read_parameter_lookup(spark, str(tmp_path / "lookup.csv")).first().process == "Persistence"


def test_replace_append_bundle(spark, tmp_path):
    df = spark.createDataFrame([("S1", 2006), ("S2", 2007)], "sampling_event_id string, year int")
    path = str(tmp_path / "t")
    tables.replace_table(df, path, ["year"])
    tables.replace_table(df, path, ["year"])
    assert tables.read_table(spark, path).count() == 2
    tables.append_table(df, path, ["year"])
    assert tables.read_table(spark, path).where("year = 2006").count() == 2
    tables.save_bundle({"a": df, "b": df.limit(1)}, str(tmp_path / "bundle"))
    assert {k: v.count() for k, v in tables.load_bundle(spark, str(tmp_path / "bundle"), ["a", "b"]).items()} == {"a": 2, "b": 1}
    assert tables.query(spark, "select count(*) from {t} where year = 2007", t=df).first()[0] == 1


def test_yearly_csv_round_trip_and_union(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 2.5, 2006), (2, 3, None, 2007)], "cell long, rep int, effort double, YEAR int")
    path = str(tmp_path / "out")
    tables.write_yearly_csv(df, path)
    assert (tmp_path / "out" / "YEAR=2006").is_dir()
    back = tables.read_yearly_csv(spark, path, df.schema)
    assert sorted(map(tuple, back.select("cell", "rep", "effort", "YEAR").collect())) == [(1, 0, 2.5, 2006), (2, 3, None, 2007)]
    (tmp_path / "a.csv").write_text("cell,n\n1,2\n")
    (tmp_path / "b.csv").write_text("cell,m\n5,6\n")
    both = files.union_yearly(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(map(tuple, both.select("cell", "n", "m").collect())) == [("1", "2", None), ("5", None, "6")]


def test_layers_and_edges(spark, tmp_path):
    px = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, 2.0)], schemas.PIXELS)
    tables.write_layers(px, str(tmp_path / "px"))
    one = tables.read_layers(spark, str(tmp_path / "px"), ["b"])
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "= b)], PushedFilters: []" in plan  # a partition filter, not a row filter
    e = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 1.0)], schemas.POLYGON_EDGES)
    polygons.write_edges(e, str(tmp_path / "edges"))
    assert polygons.read_edges(spark, str(tmp_path / "edges")).count() == 1


def test_incremental_ingest_twice_then_new_folder(spark, root, tmp_path_factory):
    out = tmp_path_factory.mktemp("ingest")
    table, log = str(out / "detections"), str(out / "log")

    def run():
        ingest_available(spark, str(root), SPECIES, table, log)
        return sorted(tuple(r) for r in spark.read.parquet(table).select("year", "sampling_event_id", "species").collect())

    first = run()
    assert len(first) == 4 and run() == first
    write_year(root, 2008, [line("S9", 2008, ["1", "0"]), line("S9", 2008, ["4", "0"])])
    assert run() == first + [(2008, "S9", "Vireo_griseus")]
    # A lost log makes every file come again: the keys already present are not added twice.
    ingest_available(spark, str(root), SPECIES, table, str(out / "other-log"))
    assert spark.read.parquet(table).count() == 5
