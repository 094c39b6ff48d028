"""Text quality by compression with dictionaries of good and bad text (operator 9)."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.llm.common import held_out, query, sample_of, sample_of_each, table
from fieldmark.llm.encoding import slices
from fieldmark.llm.excerpts import pieces
from fieldmark.session import settle

#: Labelled texts of each class for the dictionaries, and in all for the calibration.
DICTIONARY_TEXTS, CALIBRATION_TEXTS = 3_000, 8_000
#: Every text is compressed in pieces of this size; a dictionary is trained on at most so many of them, from anywhere in the texts of its class.
PIECES, PIECE_BYTES = 12_000, 2_048
DICTIONARY_BYTES, LEVEL = 112 * 1024, 3
#: Score from which a document is taken for good.
THRESHOLD = 0.7


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the texts themselves where there are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


@functools.lru_cache(maxsize=4)
def _compressor(content: bytes):
    import zstandard

    kind = zstandard.DICT_TYPE_AUTO
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind), write_content_size=False, write_checksum=False)


def sizes(text: str | None, bad: bytes, good: bytes) -> tuple[int, int, int]:
    """Compressed bytes with either dictionary and bytes of the whole text."""
    data = (text or "").encode()
    cut = pieces(data, PIECE_BYTES)
    return tuple(sum(len(_compressor(d).compress(p)) for p in cut) for d in (bad, good)) + (len(data),)


def features(found: np.ndarray) -> np.ndarray:
    """The normalised difference of both sizes, alone and weighted by how far the text compresses and how long it is.

    Every term carries the difference and is zero where the sizes are equal: length or plain compressibility decide nothing by themselves.
    """
    bad, good, n = found.astype(np.float64).T
    d = (bad - good) / np.maximum(np.maximum(bad, good), 1)
    r = np.log(np.minimum(bad, good) / np.maximum(n, 1) + 0.01)
    size = np.log(n + 10)
    up, down = np.maximum(d, 0), np.maximum(-d, 0)
    return np.stack([part * by for part in (up, down, d * d, np.sqrt(up), np.sqrt(down)) for by in (np.ones_like(d), r, size)], axis=1)


@dataclass
class Model:
    bad: bytes
    good: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float | None = None  # the score of every text where no classifier can be learnt

    def score(self, found: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(found), self.prior)
        z = np.c_[(features(found) - self.centre) / self.scale, np.ones(len(found))]
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps: centre, scale and weights."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - centre) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from labelled documents that are not held out.

    A bounded sample, those with the smallest hashes of the id: half of the ids
    feed the dictionaries, the other half the calibration.  Ids with labels of both
    kinds teach nothing.  Without texts of both classes every score is the share
    of good labels (0.5 without labels).
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).cast("long").alias("id"))
    known = known.agg(F.min(label).alias("label"), F.max(label).alias("high")).where("label = high").where(~held_out(F.col("id"))).drop("high")
    known = known.withColumn("hash", F.xxhash64("id", F.lit("quality")))
    known = settle(known)
    dict_ids = [sample_of(known.where(f"label = {c} and hash % 2 = 0"), "hash", DICTIONARY_TEXTS) for c in (0, 1)]
    calibration = sample_of(known.where("hash % 2 <> 0"), "hash", CALIBRATION_TEXTS)
    chosen = dict_ids[0].unionAll(dict_ids[1]).withColumn("use", F.lit(0)).unionAll(calibration.withColumn("use", F.lit(1)))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # a bounded number of ids, and one text of each: that with the smallest hash
    taught = rows.join(F.broadcast(chosen), "id").groupBy("id", "use").agg(F.min(F.struct(F.xxhash64("text").alias("first"), "label", "hash", "text")).alias("one")).select("id", "use", "one.*")

    def cut(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for label, hash_, text_ in zip(*(batch.column(c).to_pylist() for c in ("label", "hash", "text"))):
                got = pieces((text_ or "").encode(), PIECE_BYTES)
                order = [xxh3_64_intdigest(f"{hash_} {i}".encode()) >> 1 for i in range(len(got))]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(got), pa.int32()), pa.array(order, pa.int64()), pa.array(got, pa.binary())], names=["label", "order", "piece"])

    cuts = settle(taught.where("use = 0").select("label", "hash", "text").mapInArrow(cut, "label int, order long, piece binary"))
    got = sample_of_each(cuts, "label", "order", PIECES).toArrow().sort_by([("order", "ascending")])
    samples = [got.filter(pc.equal(got.column("label"), k)).column("piece").to_pylist() for k in (0, 1)]
    prior = known.agg(F.avg("label")).first()[0]
    if not (b"".join(samples[0]) and b"".join(samples[1])):
        return Model(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0), 0.5 if prior is None else prior)
    bad, good = dictionary(samples[0]), dictionary(samples[1])
    seen = measure(taught.where("use = 1"), bad, good, ["label"]).toArrow()
    y = seen.column("label").to_numpy()
    if len(set(y.tolist())) < 2:
        return Model(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0), prior)
    found = np.stack([seen.column(c).to_numpy() for c in ("__bad", "__good", "__bytes")], axis=1)
    return Model(bad, good, *calibrate(features(found), y))


def measure(rows: DataFrame, bad: bytes, good: bytes, keep: list[str]) -> DataFrame:
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in ("__bad", "__good", "__bytes")])

    def run(batches):
        for batch in batches:
            for cut in slices(batch, "text"):
                found = [sizes(t, bad, good) for t in cut.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in zip(*found))], names=schema.names)

    return rows.select(*keep, "text").mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """Add ``column``: how likely a document is good, 0 to 1, from its whole text alone (null: empty)."""
    schema = T.StructType([f for f in docs.schema if f.name != column] + [T.StructField(column, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for cut in slices(batch, text):
                found = np.array([sizes(t, model.bad, model.good) if model.prior is None else (0, 0, 0) for t in cut.column(text).to_pylist()])
                kept = [cut.column(f.name) for f in schema[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(model.score(found))], names=schema.names)

    return docs.mapInArrow(run, schema)


@query()
def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
