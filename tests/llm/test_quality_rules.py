"""Statistics against plain Python, the decision list against a covering learner in memory, verdicts on rows not learned from."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldmark.llm import quality_rules as rules
from fieldmark.llm.common import QUERIES, ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def failed(n_words, n_repeat_words):
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def in_order(rows, names, cuts, most_rules=16, most_literals=5, precision=0.8):
    """Sequential covering over (grow, bad, values) rows, literal by literal, without histograms."""
    left, found = list(rows), []
    bits = lambda p, n: math.log2(p / (p + n)) if p else 0.0
    holds = lambda row, lit: (row[2][lit[0]] > lit[2]) == lit[1]
    while len(found) < most_rules:
        inside, chosen = [r for r in left if r[0]], []
        while len(chosen) < most_literals and any(not r[1] for r in inside):
            p0 = sum(r[1] for r in inside)
            best, gain = None, 1e-9
            for f in range(len(names)):
                for above in (False, True):
                    for c in cuts[f]:
                        kept = [r[1] for r in inside if holds(r, (f, above, c))]
                        p = sum(kept)
                        g = p * (bits(p, len(kept) - p) - bits(p0, len(inside) - p0)) if p else 0.0
                        if g > gain + (1e-9 if best else 0):
                            best, gain = (f, above, c), g
            if best is None:
                break
            chosen.append(best)
            inside = [r for r in inside if holds(r, best)]
        if not chosen:
            break
        worth = []
        for k in range(1, len(chosen) + 1):
            kept = [r[1] for r in left if not r[0] and all(holds(r, x) for x in chosen[:k])]
            p, n = sum(kept), len(kept) - sum(kept)
            worth.append(((p - n) / (p + n), p / (p + n)) if kept else (-1.0, 0.0))
        k = max(range(len(worth)), key=lambda i: (worth[i][0], -i))
        if worth[k][1] < precision:
            break
        chosen = chosen[: k + 1]
        found.append(tuple(rules.Literal(names[f], above, c) for f, above, c in chosen))
        left = [r for r in left if not all(holds(r, x) for x in chosen)]
    return found


@pytest.fixture(scope="module")
def judged(spark, small):
    return {r.doc_id: r for r in QUERIES["op13_quality_rules"](spark, small).collect()}


def test_statistics_match_plain_python(spark, odd):
    rows = rules.judged(rules.statistics(odd), []).collect()
    texts = {(r.doc_id, r.n_chars): r.text for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        want = brute(texts[(r.doc_id, r.n_chars)])
        assert tuple(r[c] for c in rules.BASE) == want
        assert r.base_failed == failed(want[0], want[4]) and r.kept == (not r.base_failed)
    assert {"score", "row", "node"} <= set(rows[0].asDict())


def test_repeated_windows_overlap(spark):
    ship(spark)
    eight = "a b c d e f g h"
    texts = [eight, f"{eight} {eight}", f"{eight} x {eight}", " ".join("z" * 30), f"{eight} i {eight} i j {eight}", "a b c d e f g h i " * 3 + eight, "\x00   x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in rules.BASE) for r in rules.statistics(df).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}


def test_query_covers_every_document(spark, small, judged):
    assert dict(QUERIES["op13_quality_rules"](spark, small).dtypes)["n_words"] == "bigint"
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(judged) == len(docs)
    for d in docs:
        r, want = judged[d.doc_id], brute(d.text)
        assert tuple(r[c] for c in rules.BASE) == want and r.base_failed == failed(want[0], want[4])
        assert not (r.base_failed and r.kept) and all(isinstance(r[c], int) for c in rules.BASE)


def test_rules_match_a_learner_in_memory(spark):
    """Labels of three kinds with noise: the same rules in the same order."""
    ship(spark)
    df = spark.range(900).select(
        F.col("id").alias("key"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 10.0).alias("x"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)) / 10.0).alias("y"), F.lit(3.0).alias("flat"),
    )
    noisy = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(50)) == 0
    bad = ((F.col("x") > 8) & (F.col("y") <= 6)) | (F.col("y") > 9) | noisy
    names = ["x", "y", "flat"]
    got = rules.learn(df, names, bad, F.col("key"))
    rows = df.select(F.xxhash64(F.lit("rules"), "key").alias("__hash"), bad.alias("bad"), *names)
    cuts = rules.cut_points(rows, names)
    kept = [(r[0], r[1], (r.x, r.y, r.flat)) for r in rows.select(F.pmod(F.shiftright("__hash", 8), F.lit(3)) > 0, "bad", *names).collect()]
    assert got == in_order(kept, names, cuts)
    assert len(got) >= 2 and all(literal.feature != "flat" for rule in got for literal in rule)


def test_verdict_on_rows_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op13_quality_rules"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").collect()
    unseen = [(x.quality, got[x.doc_id].kept) for x in labels if zlib.crc32(str(x.doc_id).encode()) % 4 == 2 and not got[x.doc_id].base_failed]
    good = [k for q, k in unseen if q == 1]
    assert sum(good) >= 0.97 * len(good)
    bad = [k for q, k in unseen if q == 0]
    assert not bad or sum(bad) <= 0.2 * len(bad)


def test_without_both_labels_only_the_base_rules_hold(spark, odd, none):
    stats = rules.statistics(odd)
    one = spark.createDataFrame([(1, 1), (7, 1), (10, None)], "doc_id long, quality int")
    assert rules.rules_of(stats, one) == [] and rules.as_sql([]) == "true"
    assert rules.judged(rules.statistics(none), rules.rules_of(rules.statistics(none), one)).count() == 0


def test_emitted_condition_is_ordered():
    found = [(rules.Literal("a", True, 1.5), rules.Literal("b", False, 2.0)), (rules.Literal("c", True, 0.0),)]
    assert rules.as_sql(found) == "CASE WHEN a > 1.5D AND b <= 2.0D THEN false WHEN c > 0.0D THEN false ELSE true END"


def test_no_python_in_the_plan(spark, small):
    plan = QUERIES["op13_quality_rules"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
