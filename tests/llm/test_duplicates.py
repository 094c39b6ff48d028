"""Operators 2, 4, 5 and 6 against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldmark.llm import line_dedup, near_vectors, repeats, simhash
from fieldmark.llm.common import ORACLES, QUERIES, ship
from fieldmark.llm.components import components
from tests.compare import compare, oracle_connection
from tests.llm.conftest import odd_texts, words


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(600, 601 + i) for i in range(40)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(700, links)
    assert all(got.get(i, i) == want[i] for i in range(700))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup_matches_sql(spark, small):
    problem, _, _ = compare(spark, oracle_connection(small), "op2", QUERIES["op2_line_dedup"], ORACLES["op2_line_dedup"], small)
    assert problem is None


def test_line_dedup_rules(spark, none):
    rows = [(i, "h", f"menu\nown {i}\n\nmenu ", "k") for i in range(6)] + [(10 + i, "h", "copy\nof one page", "k") for i in range(9)]
    rows += [(20, None, "menu\nx", "k"), (21, "", None, "k"), (22, "h", "", "k"), (None, "h", "own 1\nmenu", "k"), (30, "z", "lone", "k")]
    df = spark.createDataFrame(rows, "page_id long, host string, text string, n_lines string")
    got = line_dedup.drop_boilerplate(df, "host", "text", ratio=0.5, least_pages=5)
    assert got.columns == ["page_id", "host", "text", "n_lines", "n_dropped"]
    rows = {(r.page_id, r.host): (r.text, r.n_lines, r.n_dropped) for r in got.collect()}
    assert all(rows[(i, "h")] == (f"own {i}\n", 3, 2) for i in range(6))
    assert all(rows[(10 + i, "h")] == ("copy\nof one page", 2, 0) for i in range(9))  # copies count once
    assert rows[(20, None)] == ("menu\nx", 2, 0) and rows[(21, "")] == (None, 0, 0) and rows[(22, "h")] == ("", 0, 0)
    assert rows[(None, "h")] == ("own 1", 2, 1) and rows[(30, "z")] == ("lone", 1, 0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert line_dedup.drop_boilerplate(none, "source", "text").count() == 0


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_on_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd, 4, 64, 5, 4).collect()
    texts = odd_texts()
    prints = [brute_print(t) for _, t in texts]
    assert Counter((r.doc_id, r.f0 & (2**64 - 1)) for r in rows) == Counter((i, p) for (i, _), p in zip(texts, prints))
    ids = [1 << 62 if i is None else i for i, _ in texts]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4 or ids[a] == ids[b] < 1 << 62]
    part = roots(len(ids), links)
    want = {(i, p): min(ids[j] for j in range(len(ids)) if part[j] == part[k]) for k, ((i, _), p) in enumerate(zip(texts, prints))}
    assert all(r.label == want[(r.doc_id, r.f0 & (2**64 - 1))] for r in rows if r.label < 1 << 62)
    assert simhash.near_duplicates(none, 4, 64, 5, 4).count() == 0


@pytest.mark.parametrize("chunk", [4_096, 40])
def test_pigeonring_loses_no_pair(spark, monkeypatch, chunk):
    """Random fingerprints with planted neighbours, many on one segment, also with buckets dealt in chunks."""
    ship(spark)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r = random.Random(5)
    prints = {r.getrandbits(64) for _ in range(200)}
    prints |= {r.getrandbits(51) << 13 | 77 for _ in range(200)}
    for p in list(prints)[:150]:
        for k in (1, 2, 3, 4, 5):
            prints.add(p ^ sum(1 << b for b in r.sample(range(64), k)))
    prints = sorted(prints)
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "node long, f0 long")
    found = [(x.a, x.b) for x in simhash.links(df, simhash.Ring(64, 5, 4)).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in found)
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert roots(len(prints), found) == roots(len(prints), near)


def vectors():
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 5] * 3 + 0.3 * r.normal(size=8)).tolist()) for i in range(60)]
    rows += [(200 + i, base[7].tolist()) for i in range(20)] + [(200, base[7].tolist())]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (303, [None] + [1.0] * 7), (304, [float("inf")] + [1.0] * 7), (305, []), (306, [1e200] * 8), (307, [1e-200] * 8), (308, [1.0, 2.0])]
    return rows


def test_near_vectors(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", 16)
    rows = vectors()
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, label long")
    got = near_vectors.near_vectors(df, "vec_id", "embedding", 0.95, cells=6).collect()
    good = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    u = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in good}
    u = {k: v / np.linalg.norm(v) for k, v in u.items()}
    links = [(a, b) for a in good for b in good if a < b and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.95]
    count = Counter(x for pair in links for x in pair)
    part = roots(len(rows), links + [(a, b) for a in good for b in good if rows[a][0] == rows[b][0]])
    want = Counter((rows[k][0], count[k], rows[part[k]][0] if k in u else rows[k][0]) for k in range(len(rows)))
    low = {}
    for k in good:
        low[part[k]] = min(low.get(part[k], 10**9), rows[k][0])
    want = Counter((rows[k][0], count[k], low[part[k]] if k in u else rows[k][0]) for k in range(len(rows)))
    assert Counter((r.vec_id, r.n_links, r.component) for r in got) == want


def brute_spans(texts, least):
    where = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        hit = [{"start": i, "stop": i + least} for i in range(len(t) - least + 1) if where[t[i : i + least]] > 1]
        out.append(repeats.merge(hit))
    return out


def got_spans(df, least):
    rows = repeats.with_spans(df, least=least).select("row.doc_id", "text", "spans").collect()
    return Counter((r.doc_id, r.text, tuple(repeats.merge([s.asDict() for s in r.spans or []]))) for r in rows)


def test_repeats_on_odd_rows(odd, none):
    texts = [(t or "").encode() for _, t in odd_texts()]
    want = Counter((i, t or "", tuple(s)) for (i, t), s in zip(odd_texts(), brute_spans(texts, 200)))
    assert got_spans(odd, 200) == want
    assert repeats.with_spans(none).count() == 0


@pytest.mark.parametrize("together", [20_000, 2])
def test_repeats_of_mixed_passages(spark, monkeypatch, together):
    """Overlapping copies with edits on either side, also where a k-gram has too many surroundings to sort."""
    ship(spark)
    monkeypatch.setattr(repeats, "TOGETHER", together)
    monkeypatch.setattr(repeats, "CUT_BYTES", 900)
    r = random.Random(9)
    source = words(11, 400)
    texts = []
    for k in range(60):
        a = r.randrange(len(source) - 700)
        piece = list(source[a : a + r.randrange(150, 700)])
        for _ in range(r.randrange(3)):
            piece[r.randrange(len(piece))] = "#"
        texts.append(words(100 + k, r.randrange(20)) + "".join(piece) + words(200 + k, r.randrange(20)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter((i, t, tuple(s)) for (i, t), s in zip(enumerate(texts), brute_spans([t.encode() for t in texts], 200)))
    assert got_spans(df, 200) == want


@given(st.lists(st.text("ab", min_size=1, max_size=12), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_intervals_are_common_prefixes(strings):
    rows, sizes = repeats._rows([s.encode() for s in strings], 12)
    order, shared = repeats._sorted(rows, sizes)
    ordered = [strings[i] for i in order]
    assert ordered == sorted(strings)
    found = {(a, b, d) for a, b, d, _ in repeats.intervals(shared, 1)}
    want = set()
    for a in range(len(ordered)):
        for b in range(a + 1, len(ordered)):
            d = min(shared[a + 1 : b + 1])
            if d >= 1 and (a == 0 or shared[a] < d) and (b + 1 == len(ordered) or shared[b + 1] < d):
                want.add((a, b, int(d)))
    assert found == want


def test_whole_characters():
    data = "aé日b".encode()
    assert repeats.whole_characters(data, [(2, 5)]) == [] and repeats.whole_characters(data, [(1, 6)]) == [(1, 6)] and repeats.whole_characters(data, [(2, 7)]) == [(3, 7)]
