import random

import pytest
from pyspark.sql import types as T

from fieldmark.llm.common import ship

DOC = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that the operators use themselves
    + [T.StructField(c, T.StringType()) for c in ("score", "id", "a", "b", "row", "spans", "ids", "piece", "label", "node", "share", "gram", "n_lines")]
)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))


def odd_texts():
    base = words(1, 120)
    passage = words(2, 60)
    return [
        (1, base), (2, base), (2, base), (None, base), (3, None), (None, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "Ünïcödé ß 日本語 " * 40), (8, words(3, 40_000)),
        (9, base.replace(" ", "  ")), (10, words(4, 30) + " " + passage + " " + words(5, 30)), (11, words(6, 30) + " " + passage), (12, "abc" * 300), (13, "x" * 5_000), (14, "tab\tand\x00zero\x0bvt " * 30),
        (15, " ".join(w if i != 60 else "changed" for i, w in enumerate(base.split()))), (16, "Hello, world's 1st A.B. test! <|endoftext|>"), (17, "123 !?"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    ship(spark)
    rows = [(i, t, "en", ("s", None)[k % 5 == 0], len(t or ""), *["x"] * (len(DOC) - 5)) for k, (i, t) in enumerate(odd_texts())]
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    ship(spark)
    return spark.createDataFrame([], DOC)
