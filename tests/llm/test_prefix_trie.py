"""The conversation trie against SQL and a trie built in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fieldmark.llm import prefix_trie as trie
from fieldmark.llm.common import ORACLES, QUERIES, ship
from tests.compare import compare, oracle_connection

COLUMNS = "conv_id long, turn long, role string, text string, score double, path string, name string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def said(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    """All nodes as a sorted list of tuples, from sequences kept whole."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, said(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        family = c - int(c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(turns.get(family, [])[:h] + own[h:])
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in sorted(convs) if rebuilt[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows, limit):
    ship(spark)
    df = spark.createDataFrame([(*r, 1.0, "x", "y") for r in rows], COLUMNS).repartition(3)
    conv = F.col("conv_id")
    paths = trie.paths(trie.turn_rows(df), conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9)
    return sorted((tuple(r[c] for c in NODE) for r in trie.trie(paths, limit).collect()), key=str)


def made_up(seed, n):
    """Conversations with few different turns: many shared prefixes, copies and early ends."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([1, 2, 3, 5, 12])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} {r.choice('aab') if t else 'é'}"))
    return rows


ODD = [
    (None, 0, "user", "no conversation"), (0, None, "user", "first"), (0, 0, "user", "second"), (0, 0, "user", "second"), (0, 0, "user", "tie"), (1, 5, None, None), (1, 6, "", ""),
    (2, 1, "user", "alone"), (-3, 0, "user", "negative"), (-5, 0, "user", "base"), (11, 0, "user", "x" * 100_000), (13, 0, "user", "no base"), (14, 0, "user", "no base"),
]


@pytest.mark.parametrize("limit", [1, 2, 7, 1000])
def test_nodes_match_a_trie_in_memory(spark, limit):
    rows = made_up(limit, 60) + [(c + 1000, t, r, x) for c, t, r, x in made_up(limit, 20)]
    assert nodes(spark, rows, limit) == brute(rows)


@pytest.mark.parametrize("limit", [1, 1000])
def test_odd_conversations(spark, limit):
    assert nodes(spark, ODD, limit) == brute(ODD)


def test_one_deep_conversation_and_its_copies(spark):
    rows = [(c, t, "user", f"{t}") for c in (0, 5, 10) for t in range(60 + c)]
    for limit in (2, 1000):
        assert nodes(spark, rows, limit) == brute(rows)


def test_an_empty_table_has_no_nodes(spark):
    assert nodes(spark, [], 10) == []


def test_matches_sql(spark, small):
    name = "op12_prefix_trie"
    problem, n, _ = compare(spark, oracle_connection(small), name, QUERIES[name], ORACLES[name], small)
    assert problem is None and n > 1
