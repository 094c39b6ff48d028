"""Replicate histories against plain Python on a survey in which one site holds a third of the lists."""

import datetime
import random
from collections import defaultdict

import pytest

from fieldmark.operators import replicates
from fieldmark.plans import occupancy

SPECIES = ["a", "b", "c"]


def survey(n=900, seed=4):
    r = random.Random(seed)
    lists, found = [], []
    for e in range(n):
        site = 0 if r.random() < 0.34 else r.randrange(1, 30)
        date = datetime.date(2000 + r.randrange(3), 5, 1) + datetime.timedelta(days=r.randrange(20))
        lists.append((e, site, date.year, date))
        found += [(e, s) for s in SPECIES[:2] if r.random() < 0.3]
    return lists, found


@pytest.fixture(scope="module")
def frames(spark):
    lists, found = survey()
    days, seen = defaultdict(set), defaultdict(set)
    where = {e: (s, y, d) for e, s, y, d in lists}
    for s, y, d in where.values():
        days[s, y].add(d)
    for e, sp in found:
        seen[where[e]].add(sp)
    return (
        spark.createDataFrame(lists, "event_id int, site int, year int, obs_date date"),
        spark.createDataFrame(found + found[:50], "event_id int, species string"),
        spark.createDataFrame([(s,) for s in SPECIES], "species string"),
        days,
        seen,
    )


def test_packed_histories(frames):
    lists, found, species, days, seen = frames
    got = {(r.site, r.year, r.species): r.history for r in replicates.packed_histories(lists, found, species, 20).collect()}
    assert len(got) == len(days) * 3
    for (s, y), ds in days.items():
        for sp in SPECIES:
            want = [int(sp in seen[s, y, d]) for d in sorted(ds)]
            assert got[s, y, sp] == want + [None] * (20 - len(want))


def test_too_narrow_a_matrix_is_refused(frames):
    lists, found, species, days, _ = frames
    width = max(len(d) for d in days.values()) - 1
    with pytest.raises(Exception, match="more than"):
        replicates.packed_histories(lists, found, species, width).collect()


def test_naive_state(frames):
    lists, found, species, days, seen = frames
    got = {(r.site, r.year, r.species): r.z0 for r in replicates.naive_state(lists, found, species).collect()}
    assert got == {
        (s, y, sp): int(any(sp in seen[s, y, d] for d in ds)) for (s, y), ds in days.items() for sp in SPECIES
    }


def test_site_histories_and_merging(frames):
    lists, found, species, days, seen = frames
    got = {(r.site, r.species): [tuple(x) for x in r.h] for r in occupancy.site_histories(lists, found, species, range(1999, 2003)).collect()}
    sites = {s for s, _ in days}
    assert set(got) == {(s, sp) for s in sites for sp in SPECIES}
    for (s, sp), h in got.items():
        want = [(len(days[s, y]), sum(sp in seen[s, y, d] for d in days[s, y])) if (s, y) in days else (0, 0) for y in range(1999, 2003)]
        assert h == want
    merged = occupancy.grouped_histories(occupancy.site_histories(lists, found, species, range(1999, 2003)))
    assert sum(r.w for r in merged.collect()) == len(got)


def test_a_species_outside_the_study_list_is_left_out(frames):
    lists, found, species, _, _ = frames
    only = species.where("species <> 'a'")
    assert {r.species for r in occupancy.site_histories(lists, found, only, range(2000, 2003)).collect()} == {"b", "c"}


def test_a_long_study_list_is_dealt_in_shares(frames):
    dates = frames[0].select("obs_date").distinct()
    got = replicates.species_shares(dates, frames[2], share_rows=1)
    pairs = got.selectExpr("obs_date", "explode(__names) as species")
    assert pairs.count() == pairs.distinct().count() == dates.count() * 3


def test_a_surveyed_year_without_a_record_is_zero(spark):
    lists = spark.createDataFrame([(1, 1, 2000), (2, 1, 2001), (3, 2, 2001)], "event_id int, site int, year int")
    found = spark.createDataFrame([(1, "a"), (3, "b")], "event_id int, species string")
    species = spark.createDataFrame([("a",), ("b",), ("c",)], "species string")
    got = {(r.species, r.year): (r.occupied, r.surveyed, r.naive_psi) for r in replicates.naive_occupancy(lists, found, species).collect()}
    assert got == {
        ("a", 2000): (1, 1, 1.0), ("a", 2001): (0, 2, 0.0), ("b", 2000): (0, 1, 0.0), ("b", 2001): (1, 2, 0.5), ("c", 2000): (0, 1, 0.0), ("c", 2001): (0, 2, 0.0)
    }


def test_width_follows_from_the_data(frames):
    lists, found, species, days, _ = frames
    wide = replicates.replicate_matrix(lists, found, species)
    assert wide.columns[-1] == f"r{max(len(d) for d in days.values())}"


def test_season_counts_cover_every_site_once_per_species(frames):
    lists, found, species, days, _ = frames
    one = lists.where("year = 2001")
    sites = sum(1 for _, y in days if y == 2001)
    got = occupancy.season_counts(one, found, species).groupBy("species").sum("w").collect()
    assert {r[0]: r[1] for r in got} == {s: sites for s in SPECIES}
