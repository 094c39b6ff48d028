"""Language of whole texts by string kernels with landmarks and ridge regression (operator 3)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.llm.common import held_out, query, sample_of_each, table
from fieldmark.llm.encoding import slices
from fieldmark.llm.vectors import matrix
from fieldmark.session import settle

#: Texts of each language that teach, and those of them that are landmarks.
TEXTS, LANDMARKS = 1_000, 48
#: N-grams of 1 to 3 bytes that occur in this many landmarks at least.
LENGTHS, IN_LANDMARKS = (1, 2, 3), 2
RIDGE, SHARPNESS = 1e-2, 6.0
#: Texts whose kernels with the landmarks are one matrix product.
BATCH = 256

_LETTER = re.compile(r"[^\W\d_]")


def codes(data: bytes) -> list[np.ndarray]:
    """The n-grams of each length as numbers, repeats included."""
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    out = []
    for n in LENGTHS:
        if len(b) < n:
            out.append(np.zeros(0, np.int32))
            continue
        code = b[: len(b) - n + 1]
        for k in range(1, n):
            code = (code << 8) | b[k : len(b) - n + 1 + k]
        out.append(code)
    return out


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # of each length, ascending; their columns follow one another
    landmarks: np.ndarray  # n-gram x landmark: 1 where the landmark has the n-gram
    weights: np.ndarray  # landmark kernels to languages
    bias: np.ndarray
    _places: list[np.ndarray] | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_places": None}  # each task makes its own

    def places(self) -> list[np.ndarray]:
        """For every possible n-gram its column, counted from 1; 0 where it has none."""
        if self._places is None:
            self._places, base = [], 1
            for n, grams in zip(LENGTHS, self.grams):
                t = np.zeros(1 << (8 * n), np.min_scalar_type(len(self.landmarks)))
                t[grams] = np.arange(base, base + len(grams))
                base += len(grams)
                self._places.append(t)
        return self._places

    def presence(self, texts: list[str]) -> np.ndarray:
        """Text x n-gram: 1 where the whole text has the n-gram."""
        out = np.zeros((len(texts), len(self.landmarks) + 1), np.float32)
        for row, text in zip(out, texts):
            for t, code in zip(self.places(), codes(text.lower().encode())):
                row[t[code]] = 1
        return out[:, 1:]

    def kernel(self, present: np.ndarray) -> np.ndarray:
        """Shared n-grams with every landmark over the root of both numbers of n-grams."""
        own = np.sqrt(np.maximum(present.sum(1), 1))
        return present @ self.landmarks / own[:, None] / np.sqrt(np.maximum(self.landmarks.sum(0), 1))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        margin = self.kernel(self.presence(texts)) @ self.weights + self.bias
        p = np.exp(SHARPNESS * (margin - margin.max(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.languages[i] for i in best], p[np.arange(len(p)), best].astype(np.float64)


def distinct_codes(text: str) -> list[np.ndarray]:
    """The different n-grams of each length of a whole text, ascending."""
    return [np.unique(c) for c in codes(text.lower().encode())]


def from_landmarks(sets: list[list[np.ndarray]], languages: list[str]) -> Model:
    """A model that knows its landmarks by their n-grams and has no weights yet."""
    grams = []
    for k in range(len(LENGTHS)):
        value, count = np.unique(np.concatenate([s[k] for s in sets]), return_counts=True)
        grams.append(value[count >= min(IN_LANDMARKS, len(sets))])
    held = np.concatenate([np.concatenate([np.isin(g, s[k]) for k, g in enumerate(grams)])[:, None] for s in sets], axis=1).astype(np.float32)
    return Model(languages, grams, held, np.zeros((len(sets), len(languages))), np.zeros(len(languages)))


def regress(model: Model, kernels: np.ndarray, y: np.ndarray) -> Model:
    """Nystroem features from the kernels of the taught texts, and one ridge regression per language."""
    among = model.kernel(model.landmarks.T.copy())
    value, vector = np.linalg.eigh(among.astype(np.float64))
    keep = value > 1e-6 * value.max()
    half = vector[:, keep] / np.sqrt(value[keep])
    phi = np.c_[kernels @ half, np.ones(len(kernels))]
    target = np.where(y[:, None] == np.arange(len(model.languages)), 1.0, -1.0)
    weight = 1 / np.bincount(y)[y]  # every language counts alike
    weight = weight / weight.mean()
    w = np.linalg.solve(phi.T @ (phi * weight[:, None]) + RIDGE * len(phi) * np.eye(phi.shape[1]) / 100, phi.T @ (target * weight[:, None]))
    model.weights, model.bias = (half @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)
    return model


def learn(texts: list[str], langs: list[str], landmarks: int = LANDMARKS) -> Model:
    """Nystroem features of the blended-spectrum presence kernel and one ridge regression per language, from a few texts in memory."""
    languages = sorted(set(langs))
    y = np.array([languages.index(c) for c in langs])
    picked = np.concatenate([np.flatnonzero(y == c)[:landmarks] for c in range(len(languages))])
    model = from_landmarks([distinct_codes(texts[i]) for i in picked], languages)
    kernels = np.concatenate([model.kernel(model.presence(texts[i : i + BATCH])) for i in range(0, len(texts), BATCH)])
    return regress(model, kernels, y)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Learn from a bounded number of whole documents per language, those with the smallest hashes of the id.

    Held-out rows, rows without a language and texts without a letter teach nothing; None if nothing teaches.
    Texts are read in tasks: the driver gets the n-grams of the landmarks, and of every other text its
    kernels with them, however long the text is.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))

    def lettered(batches):
        for batch in batches:
            yield batch.filter(pa.array([_LETTER.search(t) is not None for t in batch.column("text").to_pylist()], pa.bool_()))

    hashed = rows.select("text", "lang", F.xxhash64("id", F.lit("language"), "text").alias("hash"))
    # hashes first, so that texts of the chosen rows alone move
    chosen = sample_of_each(hashed.select("lang", "hash").distinct(), "lang", "hash", TEXTS)
    taught = hashed.join(chosen, ["lang", "hash"]).dropDuplicates(["lang", "hash"]).select("text", "lang", "hash").mapInArrow(lettered, "text string, lang string, hash long")
    taught = settle(taught.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))))  # at most TEXTS of a language

    def grams(batches):
        for batch in batches:
            found = [distinct_codes(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array([[c.tobytes() for c in s] for s in found], pa.list_(pa.binary()))], names=["lang", "place", "grams"])

    marks = taught.where(F.col("place") <= LANDMARKS).mapInArrow(grams, "lang string, place int, grams array<binary>").toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    if not len(marks):
        return None
    names = marks.column("lang").to_pylist()
    model = from_landmarks([[np.frombuffer(c, np.int32) for c in s] for s in marks.column("grams").to_pylist()], sorted(set(names)))

    def kernels(batches):
        for batch in (cut for whole in batches for cut in slices(whole, "text")):
            found = model.kernel(model.presence(batch.column("text").to_pylist())).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("hash"), pa.array(list(found), pa.list_(pa.float32()))], names=["lang", "hash", "kernel"])

    got = taught.mapInArrow(kernels, "lang string, hash long, kernel array<float>").toArrow().sort_by([("hash", "ascending"), ("lang", "ascending")])
    places = {c: i for i, c in enumerate(model.languages)}
    y = np.array([places[c] for c in got.column("lang").to_pylist()])
    return regress(model, matrix(got.column("kernel")), y)


def predict(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the language of the whole text and its score; ``und`` and 0 where there is no letter or nothing was learnt."""
    schema = T.StructType([f for f in docs.schema if f.name not in (lang, score)] + [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        for batch in (cut for whole in batches for cut in slices(whole, text)):
            texts = batch.column(text).to_pylist()
            known = [i for i, t in enumerate(texts) if model and t and _LETTER.search(t)]
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            for start in range(0, len(known), BATCH):
                some = known[start : start + BATCH]
                found, p = model.predict([texts[i] for i in some])
                for i, name in zip(some, found):
                    names[i] = name
                scores[some] = p
            kept = [batch.column(f.name) for f in schema[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return docs.mapInArrow(run, schema)


@query()
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
