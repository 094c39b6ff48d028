"""Near-duplicate texts by SimHash fingerprints and pigeonring filtering (operator 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import changes, query, table, whole_groups
from fieldmark.llm.components import Forest, components
from fieldmark.llm.encoding import slices
from fieldmark.session import checked_broadcast, settle

#: Rows of a bucket that one task compares with one another; larger buckets are dealt in chunks.
CHUNK = 4_096
#: Shingles whose bits are counted at once.
COUNT_AT_ONCE = 65_536
#: Odd factors that turn one hash of a shingle into further words of the fingerprint.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, repeats included.

    Only A-Z are lower-cased and only ASCII white space parts words; a text with
    fewer words has one shingle, a text without words none.
    """
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.cumsum(sizes + 1) - sizes - 1
    n = max(1, len(parts) - words + 1)
    end = start[len(parts) - n :] + sizes[len(parts) - n :]
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(start[:n].tolist(), end.tolist())), np.uint64, n)


def fingerprint(hashes: np.ndarray, bits: int = 64) -> list[int]:
    """Signed 64-bit words: a bit is set if it is set in over half the hashes; all zero without hashes."""
    out = []
    for k in range(bits // 64):
        count = np.zeros(64, np.int64)
        for i in range(0, len(hashes), COUNT_AT_ONCE):
            h = hashes[i : i + COUNT_AT_ONCE]
            if k:
                h = h * np.uint64(FACTORS[k - 1])
                h = (h ^ (h >> np.uint64(29))) * np.uint64(FACTORS[k - 1])
                h = h ^ (h >> np.uint64(32))
            set_ = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += set_.sum(0, dtype=np.int64)
        out.append(int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<i8")[0]))
    return out


def row_id(key: str, text: str) -> Column:
    """The id of a row; a row without one gets a number from its text, above any real id."""
    own = F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    return F.coalesce(F.col(key).cast("long"), own)


def fingerprints(docs: DataFrame, words: int, bits: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id (row_id), key, f0, f1, ..."""
    named = [f"f{k}" for k in range(bits // 64)]
    rows = docs.select(row_id(key, text).alias("id"), F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            for cut in slices(batch, "__text"):
                found = [fingerprint(shingle_hashes(t, words), bits) for t in cut.column("__text").to_pylist()]
                cols = [pa.array([f[k] for f in found], pa.int64()) for k in range(bits // 64)]
                yield pa.RecordBatch.from_arrays([cut.column("id"), cut.column(key), *cols], names=["id", key, *named])

    return rows.mapInArrow(run, ", ".join(["id long", f"{key} long", *(f"{n} long" for n in named)]))


class Ring:
    """A fingerprint's bits as a ring of ``m`` segments, for pairs with at most ``tau`` differing bits.

    If all differences sum to at most tau, some segment starts a chain whose
    first l segments differ in at most l * tau / m bits, for every l.  So a pair
    is looked for where a first segment agrees and, if two segments may differ in
    one bit only, one half of the next agrees too; the remaining chain is checked
    before the full distance.  With tau < m this finds every pair.  With a larger
    tau a first segment may differ too, so pairs are found with the
    probability that one of the m segments agrees.
    """

    def __init__(self, bits: int, m: int, tau: int):
        self.bits, self.m, self.tau, self.words = bits, m, tau, bits // 64
        edge = [bits * i // m for i in range(m + 1)]
        self.segments = [(edge[i], edge[i + 1]) for i in range(m)]
        self.exact = tau < m
        self.lengths = list(range(2, m)) if m <= 8 else [2, 4, 8]
        self.budget = [length * tau // m for length in range(m + 1)]
        # masks[start, place of the length] has the bits of the chain's segments
        masks = np.zeros((m, len(self.lengths), self.words), np.uint64)
        for i in range(m):
            for at, length in enumerate(self.lengths):
                for s in range(length):
                    for bit in range(*self.segments[(i + s) % m]):
                        masks[i, at, bit // 64] |= np.uint64(1 << (bit % 64))
        self.masks = masks

    def _value(self, low: int, high: int) -> Column:
        """Bits low to high of the fingerprint as a number."""
        out = None
        while low < high:
            word, stop = low // 64, min(high, (low // 64 + 1) * 64)
            part = F.shiftrightunsigned(F.col(f"f{word}"), low % 64).bitwiseAND(F.lit((1 << (stop - low)) - 1))
            part = part if out is None else F.shiftleft(part, low - first)
            if out is None:
                first = low
            out = part if out is None else out.bitwiseOR(part)
            low = stop
        return out

    def keyed(self, prints: DataFrame) -> DataFrame:
        """Each fingerprint under all its keys: bucket, ring (number of the first segment) and its columns."""
        keys = []
        for i, (low, high) in enumerate(self.segments):
            a, b = self.segments[(i + 1) % self.m]
            halves = [(a, (a + b) // 2), ((a + b) // 2, b)] if self.exact and self.budget[1] == 0 and self.budget[2] == 1 else [None]
            for h, half in enumerate(halves):
                value = [self._value(low, high)] + ([self._value(*half)] if half else [])
                keys.append(F.struct(F.lit(i).alias("ring"), F.xxhash64(F.lit(i), F.lit(h), *value).alias("bucket")))
        named = [f"f{k}" for k in range(self.words)]
        return prints.select("node", *named, F.explode(F.array(*keys)).alias("key")).select("key.bucket", "key.ring", "node", *named)

    def close(self, prints: np.ndarray, ring: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows whose chain and full distance are within their budgets."""
        for at, length in enumerate(self.lengths):
            diff = (prints[left] ^ prints[right]) & self.masks[ring[left], at]
            near = np.bitwise_count(diff).sum(1) <= self.budget[length]
            left, right = left[near], right[near]
        near = np.bitwise_count(prints[left] ^ prints[right]).sum(1) <= self.tau
        return left[near], right[near]


def links(prints: DataFrame, ring: Ring) -> DataFrame:
    """Links (a, b) that join all near fingerprints of ``prints`` (node, f0, ...), distinct in the latter.

    A task compares whole buckets and keeps a spanning forest of what it finds,
    so a large group of near copies never becomes all its pairs.  Buckets of more
    than ``CHUNK`` rows are dealt in chunks by a hash; a task then compares two chunks.
    """
    named = [f"f{k}" for k in range(ring.words)]
    keyed = ring.keyed(prints)
    # only large buckets are looked up; they are few, else the join is not broadcast
    large = checked_broadcast(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK))
    chunks = F.ceil(F.coalesce("n", F.lit(1)) / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")).cast("int")
    tasks = (
        keyed.join(large, "bucket", "left")
        .withColumn("chunks", chunks)
        .withColumn("own", own)
        .select("bucket", "ring", "node", *named, "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    )
    dealt = tasks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(whole: pa.Table):
        bucket = whole.column("bucket").to_numpy()
        side, i, j = (whole.column(c).to_numpy() for c in ("own", "i", "j"))
        order = np.lexsort((side, j, i, bucket))
        bucket, side, i, j = bucket[order], side[order], i[order], j[order]
        node, start = whole.column("node").to_numpy()[order], whole.column("ring").to_numpy()[order]
        prints = np.stack([whole.column(n).to_numpy()[order] for n in named], axis=1).view(np.uint64)
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        ends = np.append(np.flatnonzero(new)[1:], len(bucket))[np.cumsum(new) - 1]
        found = Forest(node)
        rows, step = np.flatnonzero(np.arange(len(bucket)) + 1 < ends), 1
        while len(rows):
            other = rows + step
            # two different chunks are compared across only
            apart = (i[rows] == j[rows]) | (side[rows] != side[other])
            apart &= found.root[found.index[rows]] != found.root[found.index[other]]
            found.add(*ring.close(prints, start, rows[apart], other[apart]))
            step += 1
            rows = rows[rows + step < ends[rows]]
        return found.links()

    def run(batches):
        for whole in whole_groups(batches, ["bucket", "i", "j"], 200_000):
            a, b = compare(whole)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.select("bucket", "ring", "node", *named, "own", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = 64, segments: int = 5, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Class of every document: id, key, f0, ..., label (smallest id reachable by links).

    Fingerprints with at most ``distance`` differing bits are linked.  Equal
    fingerprints are one node, whatever their number; a null or empty text has the
    zero fingerprint and is linked like any other.  Rows that share an id are one
    document.  Rows with a null id get an id from their text that is above any real one.
    """
    named = [f"f{k}" for k in range(bits // 64)]
    prints = settle(fingerprints(docs, words, bits, key, text))
    nodes = settle(prints.groupBy(*named).agg(F.min("id").alias("node")))
    shared = prints.join(nodes, named).where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    # an id with several texts joins their fingerprints
    again = shared.join(nodes.select(F.col("node").alias("a")), "a", "left_semi")
    found = components(links(nodes, Ring(bits, segments, distance)).unionAll(again))
    labelled = nodes.join(found, "node", "left").select(*named, F.coalesce("component", "node").alias("label"))
    return prints.join(labelled, named)


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=64, segments=5, distance=4)
    real = F.when(F.col("label") < F.lit(1 << 62), F.col("label"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), real.alias("component_id"))
