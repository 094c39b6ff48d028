"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products (operator 4)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import query, table
from fieldmark.llm.components import Forest, components
from fieldmark.llm.vectors import matrix, sample, unit, usable
from fieldmark.session import settle

#: Vectors from which the cells' centres are learnt (those with the smallest hashes).
TRAIN_ROWS = 20_000
#: Cells for each 4,096 vectors, and the most there may be (centres travel to every task).
CELL_ROWS, MOST_CELLS = 4_096, 2_048
#: Vectors of a cell that are held as one block.
BLOCK_ROWS = 4_096
PROBE_ROWS = 1_024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of unit vectors by cosine; an empty cell takes the vector farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ centres.T
        cell = near.argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        lost = np.flatnonzero(size[:, 0] < 1e-9)
        total[lost] = x[np.argsort(near.max(1))[: len(lost)]]
        size[lost] = 1.0
        centres = total / size
    return unit(centres)


def _cells(vectors: DataFrame, centres: np.ndarray, threshold: float) -> DataFrame:
    """Each vector in its own cell (home) and in every earlier cell that may hold a partner.

    A partner lies within the chord 2 - 2 * threshold.  If its home is cell i and this
    vector's is h, the plane between both centres separates them, so this vector
    is no farther from the plane than the chord; only then it visits cell i.
    A pair of two homes is compared in one of them: visits go to smaller numbers only.
    """
    chord = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    gap = centres[:, None, :] - centres[None, :, :]
    apart = np.sqrt((gap * gap).sum(2))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = unit(matrix(batch.column("vector")))
            near = x @ centres.T
            home = near.argmax(1)
            best = near[np.arange(len(x)), home]
            visits = (best[:, None] - near) <= chord * apart[home] + 1e-12
            visits &= np.arange(len(centres)) < home[:, None]
            row, cell = np.nonzero(visits)
            rows = np.concatenate((np.arange(len(x)), row))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((home, cell)).astype(np.int32)),
                    pa.array(np.concatenate((np.ones(len(x), bool), np.zeros(len(row), bool)))),
                    *(batch.column(c).take(take) for c in ("node", "copies", "vector")),
                ],
                names=["cell", "home", "node", "copies", "vector"],
            )

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.mapInArrow(run, f"cell int, home boolean, node long, copies long, vector {kind}")


def _compare(tasks: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, n): b null for the number n of vectors linked to a, else a link that joins two parts.

    A task holds one block of a cell and the probes of another (or the block alone,
    against itself).  It keeps counts and a spanning forest, never the list of pairs.
    """

    def run(group: pa.Table) -> pa.Table:
        base = group.column("base").to_numpy()
        order = np.argsort(~base, kind="stable")
        node, copies = group.column("node").to_numpy()[order], group.column("copies").to_numpy()[order]
        x, n = unit(matrix(group.column("vector")))[order], int(base.sum())
        itself = group.column("i")[0] == group.column("j")[0]
        forest, count = Forest(node), np.zeros(len(node))
        for start in range(0 if itself else n, n if itself else len(node), PROBE_ROWS):
            stop = min(start + PROBE_ROWS, n if itself else len(node))
            hit = x[start:stop] @ x[:n].T >= threshold
            if itself:  # each pair once
                hit &= np.arange(n) > np.arange(start, stop)[:, None]
            r, c = np.nonzero(hit)
            if len(r):
                hit = hit.astype(np.float64)
                count[start:stop] += hit @ copies[:n]
                count[:n] += copies[start:stop] @ hit
                forest.add(r + start, c)
        linked = np.flatnonzero(count)
        a, b = forest.links()
        return pa.table(
            {
                "a": pa.array(np.concatenate((node[linked], a))),
                "b": pa.array(np.concatenate((np.zeros(len(linked), np.int64), b)), mask=np.arange(len(linked) + len(a)) < len(linked)),
                "n": pa.array(np.concatenate((count[linked].astype(np.int64), np.zeros(len(a), np.int64)))),
            }
        )

    return tasks.groupBy("cell", "i", "j").applyInArrow(run, "a long, b long, n long")


def near_vectors(df: DataFrame, key: str, vector: str, threshold: float, cells: int | None = None) -> DataFrame:
    """One row per vector: key, n_links, component (smallest key reachable by links).

    Every pair with a cosine of ``threshold`` or more is a link, however far apart its
    labels or cells.  Equal vectors are compared once for all of them.  A vector
    that is null, empty, zero or not finite links with nothing; vectors of
    different length never link.  Rows that share a key are each other's copies only
    if their vectors link; rows with a null key are returned without a component
    and take part with a number that stands after all keys.
    """
    rows = df.select(F.col(key).cast("long").alias(key), F.col(vector).alias("vector"))
    good = rows.where(usable(F.col("vector"))).withColumn("id", F.coalesce(key, F.xxhash64("vector").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)))
    distinct = settle(good.groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("copies")))
    links = None
    for (length,) in distinct.select(F.size("vector")).distinct().collect():  # lengths, one in a regular table
        part = distinct.where(F.size("vector") == length)
        n = part.count()
        k = cells or max(1, min(MOST_CELLS, math.ceil(n / CELL_ROWS)))
        centres = spherical_kmeans(unit(sample(part, "vector", TRAIN_ROWS)), k)
        found = _links(settle(_cells(part, centres, threshold)), threshold)
        links = found if links is None else links.unionAll(found)
    if links is None:
        links = df.sparkSession.createDataFrame([], "a long, b long, n long")
    links = settle(links)
    partners = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    again = good.join(distinct.select("vector", "node"), "vector").where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    again = again.join(distinct.select(F.col("node").alias("a")), "a", "left_semi")
    parts = components(links.where("b is not null").select("a", "b").unionAll(again))
    classes = distinct.join(partners, "node", "left").join(parts, "node", "left")
    classes = classes.select("vector", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    linked = good.join(classes, "vector").select(key, "n_links", F.when(F.col("component") < F.lit(1 << 62), F.col("component")).alias("component"))
    alone = rows.where(~usable(F.col("vector"))).select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component"))
    return linked.unionAll(alone)


def _links(members: DataFrame, threshold: float) -> DataFrame:
    """Compare within cells; a cell of any size is dealt in blocks of about BLOCK_ROWS, of homes and of visitors."""
    home = F.col("home").cast("int")
    blocks = [F.ceil(F.sum(c) / BLOCK_ROWS).cast("int").alias(name) for name, c in (("homes", home), ("visitors", 1 - home))]
    sizes = members.groupBy("cell").agg(*blocks)
    sized = members.join(F.broadcast(sizes), "cell")  # at most MOST_CELLS rows
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.greatest(F.when(F.col("home"), F.col("homes")).otherwise(F.col("visitors")), F.lit(1))).cast("int")
    sized = sized.withColumn("own", F.when(F.col("home"), own).otherwise(F.col("homes") + own)).where("homes > 0")
    base = sized.where("home").withColumn("j", F.explode(F.expr("sequence(own, homes + visitors - 1)")))
    base = base.select("cell", F.col("own").alias("i"), "j", F.lit(True).alias("base"), "node", "copies", "vector")
    probe = sized.where("own > 0").withColumn("i", F.explode(F.expr("sequence(0, least(own, homes) - 1)")))
    probe = probe.select("cell", "i", F.col("own").alias("j"), F.lit(False).alias("base"), "node", "copies", "vector")
    return _compare(base.unionAll(probe), threshold)


@query()
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.95)
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
