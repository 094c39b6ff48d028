"""Key checks, numbering, joins, sets and properties on small literal tables."""

import random

from pyspark.sql import functions as F

from fieldmark.operators import numbering, pruning, relational, scaling


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_null_keys_match_only_when_asked(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, b string")
    assert rows(relational.natural_join(a, b)) == [(1, "x", "p")]
    assert rows(relational.null_safe_join(a, b)) == [(None, "y", "q"), (1, "x", "p")]
    assert rows(relational.null_key_report(a, ["k"])) == [("k", 1)]


def test_natural_join_needs_a_shared_column(spark):
    a, b = spark.range(1).toDF("a"), spark.range(1).toDF("b")
    try:
        relational.natural_join(a, b)
    except ValueError:
        return
    raise AssertionError("joined without a key")


def test_pivot_then_unpivot_is_identity(spark):
    long = spark.createDataFrame([(i, s, str(i)) for i in range(4) for s in "ab"], "id int, species string, n string")
    wide = relational.to_wide(long, ["id"], "species", ["a", "b"], F.first("n"))
    assert rows(relational.to_long(wide, ["id"], ["a", "b"], "species", "n")) == rows(long)


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(2, "y")], "k int, b string")
    assert rows(relational.union_all([a, b]), "k") == [(1, "x", None), (2, None, "y")]


def test_union_of_filters_keeps_repeats(spark):
    df = spark.range(6).toDF("v")
    out = relational.union_of_filters(df, [F.col("v") > 3, F.col("v") > 4, F.col("v") == 0])
    assert [r[0] for r in out.orderBy("v").collect()] == [0, 4, 5, 5]


def test_level_order(spark):
    df = spark.createDataFrame([("b",), ("z",), ("a",)], "v string")
    ranked = relational.sorted_by_levels(df.where("v <> 'z'"), "v", ["b", "a"])
    assert [r[0] for r in ranked.collect()] == ["b", "a"]
    assert df.where("v = 'z'").select(relational.level_rank("v", ["b", "a"])).first()[0] is None


def test_duplicates_and_orphans(spark):
    child = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string")
    parent = spark.createDataFrame([("b",)], "k string")
    assert rows(relational.duplicate_keys(child, ["k"])) == [("a", 2)]
    assert rows(relational.orphan_keys(child, parent, "k")) == [("a", 2), ("c", 1)]


def test_surrogate_ids_are_dense_and_ordered(spark):
    keys = [f"s{i:04d}" for i in range(500)]
    shuffled = keys * 2
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame([(k,) for k in shuffled] + [(None,)], "site string")
    got = rows(numbering.surrogate_ids(df, "site"), "id")
    assert got == [(k, i + 1) for i, k in enumerate(keys)]


def test_row_numbers_of_a_hot_group_cross_blocks(spark):
    data = [("hot", i * 3) for i in range(900)] + [("cold", i) for i in range(10)]
    df = spark.createDataFrame(data, "g string, v long")
    got = numbering.grouped_row_number(df, ["g"], "v", "n", block=64)
    want = [("cold", i, i + 1) for i in range(10)] + [("hot", i * 3, i + 1) for i in range(900)]
    assert rows(got, "g", "v") == want


def test_pruning_is_idempotent_and_blind_to_row_order(spark):
    r = random.Random(2)
    data = [(r.randrange(20), 2000 + r.randrange(5), r.randrange(40)) for _ in range(1500)]
    df = spark.createDataFrame(data, "site int, year int, d int").withColumn("obs_date", F.date_add(F.lit("2000-01-01").cast("date"), "d"))
    once = df.join(pruning.well_surveyed_sites(df, min_replicates=10, min_years=4), "site", "left_semi")
    twice = once.join(pruning.well_surveyed_sites(once, min_replicates=10, min_years=4), "site", "left_semi")
    assert rows(once) == rows(twice)
    other = df.orderBy(F.rand(3))
    assert rows(pruning.well_surveyed_sites(df, min_replicates=10, min_years=4)) == rows(
        pruning.well_surveyed_sites(other, min_replicates=10, min_years=4)
    )


def test_drop_unseen(spark):
    df = spark.createDataFrame(
        [(1, "a", 1), (1, "b", 0), (2, "a", 0), (2, "b", 0)], "site int, species string, detected int"
    )
    assert rows(pruning.drop_unseen(df).select("site", "species", "detected")) == [(1, "a", 1)]


def test_zscores_of_degenerate_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", 1.0), ("c", 3.0)], "g string, v double")
    got = rows(scaling.zscore_by(df, ["g"], ["v"]).select("g", "v_z"))
    assert got[0] == ("a", None) and got[1] == ("b", None)
    assert [round(v, 6) for _, v in got[3:]] == [-0.707107, 0.707107]
    assert rows(scaling.zscore_global(df.where("g = 'b'"), ["v"]).select("v_z")) == [(None,), (None,)]
