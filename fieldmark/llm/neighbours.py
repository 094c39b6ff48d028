"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 1).

Graph and search keep one row per node or query with the lists of its nearest.
A round sends pairs to these rows and one merge by key updates the lists; what
entered a list in the last round is new, and only pairs with a new member meet.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import changes, discard, query, release, stored, table, whole_groups
from fieldmark.llm.vectors import matrix, usable
from fieldmark.session import settle, spread

#: Neighbours of a node in the graph; as many reverse ones are used beside them.
NEIGHBOURS = 24
#: Random partitions that give the first neighbours, and the rows of one leaf; leaves dealt by chance have fewer.
PARTITIONS, LEAF_ROWS, CHANCE_ROWS = 6, 512, 128
#: Rounds of neighbours of neighbours go on until no more than SETTLED of the neighbours change.
SETTLED = 0.01
#: Candidates that a search keeps and expands for each doubling of the table, and candidates that are measured exactly.
BEAM, EXACT = 20, 60


def beam_for(count: int) -> int:
    """Candidates that a search keeps among ``count`` nodes: a graph of more nodes has more places to lose the way."""
    return max(100, BEAM * math.ceil(math.log2(max(2, count))))


@dataclass
class Index:
    """nodes (node, vector, code, scale: one row per distinct vector), members (node, key), graph (node, ids, codes, scales)."""

    nodes: DataFrame
    members: DataFrame
    graph: DataFrame


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components as 16-bit numbers of a vector's own scale; only the graph works on these."""
    scale = np.abs(x).max(1) / 32_767
    return np.rint(x / scale[:, None]).astype(np.int16), scale


def _decoded(codes: pa.Array, scales: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.int16).reshape(len(scales), -1)
    return raw.astype(np.float32) * scales.astype(np.float32)[:, None]


def _nearness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minus the squared distance of every row of ``a`` to every row of ``b``."""
    middle = b.mean(0)  # near rows far from zero would differ in the last digits only
    a, b = a - middle, b - middle
    return 2 * a @ b.T - (a * a).sum(1)[:, None] - (b * b).sum(1)


def _leaves(nodes: DataFrame, count: int, dim: int, seed: int) -> DataFrame:
    """Nodes dealt by the sides of random planes, and once by chance: leaf, node, code, scale."""
    depth = max(0, math.ceil(math.log2(max(1, count / LEAF_ROWS))))
    planes = np.random.default_rng(seed).normal(size=(PARTITIONS, dim, depth))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("vector"))
            for t in range(PARTITIONS):
                sides = (x @ planes[t] > 0) @ (1 << np.arange(depth)) if depth else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sides.astype(np.int64) * (PARTITIONS + 1) + t), *(batch.column(c) for c in ("node", "code", "scale"))], names=["leaf", "node", "code", "scale"])

    planar = nodes.mapInArrow(run, "leaf long, node long, code binary, scale double")
    groups = max(1, count // min(LEAF_ROWS, CHANCE_ROWS))
    chance = nodes.select((F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(groups)) * (PARTITIONS + 1) + PARTITIONS).alias("leaf"), "node", "code", "scale")
    return planar.unionAll(chance)


def _first(leaves: DataFrame, k: int) -> DataFrame:
    """Nearest nodes within each leaf (u, v, s); a leaf of any size is dealt in blocks."""
    sizes = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * LEAF_ROWS)).cast("int").alias("blocks"))
    dealt = leaves.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), "blocks"))

    def run(batches):
        for rows in whole_groups(batches, ["leaf", "block"], 4_096):
            node = rows.column("node").to_numpy()
            x = _decoded(rows.column("code").combine_chunks(), rows.column("scale").to_numpy())
            u, v, s = [], [], []
            bounds = [0, *changes(rows, ["leaf", "block"]).tolist(), len(rows)]
            for a, b in zip(bounds, bounds[1:]):
                if b - a > 1:
                    near = _nearness(x[a:b], x[a:b])
                    np.fill_diagonal(near, -np.inf)
                    most = min(k, b - a - 1)
                    best = np.argpartition(-near, most - 1, axis=1)[:, :most]
                    u.append(np.repeat(node[a:b], most))
                    v.append(node[a:b][best].ravel())
                    s.append(np.take_along_axis(near, best, 1).ravel())
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (u, v, s)], names=["u", "v", "s"])

    sort = spread(dealt.select("leaf", "block", "node", "code", "scale"), "leaf", "block").sortWithinPartitions("leaf", "block")
    return sort.mapInArrow(run, "u long, v long, s float")


#: A row of lists: the nearest of node or query ``u``, nearest first, and whether they came in the last round.
_LISTS = "u long, code binary, scale double, ids array<long>, near array<float>, new array<boolean>"


def _nearest_of_each(u: np.ndarray, v: np.ndarray, s: np.ndarray, old: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest v of each u, by u and nearness, ties to the smaller v; of equal pairs an old one stays, then the nearest."""
    order = np.lexsort((-s, ~old, v, u))
    a, b = u[order], v[order]
    order = order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))]
    order = order[np.lexsort((v[order], -s[order], u[order]))]
    a = u[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    return order[rank < k]


def _merged(lists: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Lists with the pairs (u, v, s) taken in, k long at most; only what was not there before is new."""
    base = lists.select("u", F.lit(None).cast("long").alias("v"), F.lit(None).cast("float").alias("s"), "code", "scale", "ids", "near")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("code", "binary"), ("scale", "double"), ("ids", "array<long>"), ("near", "array<float>"))]
    rows = spread(base.unionAll(pairs.select("u", "v", "s", *none)), "u").sortWithinPartitions("u")

    def run(batches):
        for chunk in whole_groups(batches, ["u"], 100_000):
            own = chunk.filter(chunk.column("code").is_valid()).combine_chunks()
            met = chunk.filter(chunk.column("code").is_null())
            if not len(own):
                continue
            key, held = own.column("u").to_numpy(), own.column("ids").combine_chunks()
            sizes = np.diff(held.offsets.to_numpy())
            u = np.concatenate([np.repeat(key, sizes), met.column("u").to_numpy()])
            v = np.concatenate([held.flatten().to_numpy(), met.column("v").to_numpy()])
            s = np.concatenate([own.column("near").combine_chunks().flatten().to_numpy(), met.column("s").to_numpy()])
            old = np.arange(len(u)) < sizes.sum()
            best = _nearest_of_each(u, v, s, old, k) if len(u) else np.zeros(0, np.int64)
            ends = np.searchsorted(u[best], key, side="right")  # keys ascend
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            found = [pa.ListArray.from_arrays(offsets, pa.array(c[best])) for c in (v, s, ~old)]
            for batch in pa.table([own.column("u"), own.column("code"), own.column("scale"), *found], names=["u", "code", "scale", "ids", "near", "new"]).to_batches():
                yield batch

    return rows.mapInArrow(run, _LISTS)


def _worst(k: int):
    """The nearness that a newcomer must surpass."""
    return F.when(F.size("ids") >= k, F.element_at("near", -1)).otherwise(F.lit(float("-inf"))).cast("float").alias("worst")


def _around(lists: DataFrame, k: int) -> DataFrame:
    """Every node and both kinds of its neighbours with their codes: w, node, new, code, scale, worst; reverse neighbours are the k nearest."""
    edges = lists.select("u", F.inline(F.arrays_zip("ids", "near", "new"))).toDF("u", "v", "s", "new")
    order = Window.partitionBy("w").orderBy(F.desc("s"), "node")
    back = edges.select(F.col("v").alias("w"), F.col("u").alias("node"), "s", "new").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    itself = lists.select(F.col("u").alias("w"), F.col("u").alias("node"), F.lit(False).alias("new"))
    both = edges.select(F.col("u").alias("w"), F.col("v").alias("node"), "new").unionAll(back.select("w", "node", "new")).unionAll(itself)
    return both.join(lists.select(F.col("u").alias("node"), "code", "scale", _worst(k)), "node")


def _meet(around: DataFrame, k: int) -> DataFrame:
    """Neighbours of the same node come to know each other, if one of them is new and that is nearer than what they have: u, v, s."""

    def run(batches):
        for rows in whole_groups(batches, ["w"], 50_000):
            node, worst, new = (rows.column(c).to_numpy() for c in ("node", "worst", "new"))
            x = _decoded(rows.column("code").combine_chunks(), rows.column("scale").to_numpy())
            bounds = [0, *changes(rows, ["w"]).tolist(), len(rows)]
            u, v, s = [], [], []
            for a, b in zip(bounds, bounds[1:]):
                if not new[a:b].any():
                    continue
                near = _nearness(x[a:b], x[a:b])
                fresh = (new[a:b, None] | new[a:b]) & (node[a:b, None] != node[a:b])
                r, c = np.nonzero(fresh & (near > worst[a:b, None]))
                u.append(node[a:b][r])
                v.append(node[a:b][c])
                s.append(near[r, c])
            if u:
                u, v, s = (np.concatenate(c) for c in (u, v, s))
            if len(u):
                # no more than k for each u leave the task together, also where a node is near very many others
                best = _nearest_of_each(u, v, s, np.zeros(len(u), bool), k)
                yield pa.RecordBatch.from_arrays([pa.array(c[best]) for c in (u, v, s)], names=["u", "v", "s"])

    sort = spread(around.select("w", "node", "new", "code", "scale", "worst"), "w").sortWithinPartitions("w")
    return sort.mapInArrow(run, "u long, v long, s float")


def build(df: DataFrame, key: str, vector: str, neighbours: int = NEIGHBOURS, rounds: int | None = None, seed: int = 11) -> Index:
    """Index every usable vector.

    Rounds go on until the graph has settled, which it always does, as lists only
    get nearer; if ``rounds`` are given and do not suffice, a RuntimeWarning says so.

    Equal vectors are one node, named by their smallest key.  Null, empty, zero
    and not finite vectors and rows without a key take no part.  All vectors have one length.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).where(F.col(key).isNotNull() & usable(F.col(vector)))
    kind = rows.schema["vector"].dataType.simpleString()

    def coded(batches):
        for batch in batches:
            if len(batch):
                codes, scale = _codes(matrix(batch.column("vector")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale)], names=["node", "vector", "code", "scale"])

    distinct = rows.groupBy("vector").agg(F.min("key").alias("node")).select("node", "vector")
    nodes = settle(distinct.mapInArrow(coded, f"node long, vector {kind}, code binary, scale double"))
    members = settle(rows.join(nodes.select("vector", "node"), "vector").select("node", "key").distinct())
    size = nodes.agg(F.count("*"), F.max(F.size("vector"))).first()
    alone = nodes.select(F.col("node").alias("u"), "code", "scale", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("near"))
    lists = stored(_merged(alone, _first(_leaves(nodes, size[0], size[1] or 1, seed), neighbours), neighbours), "neighbours")
    new, total, done = size[0], 0, 0
    while rounds is None or done < rounds:
        before, lists = lists, stored(_merged(lists, _meet(_around(lists, neighbours), neighbours), neighbours), "neighbours")
        discard(before)
        release(spark)
        done += 1
        fresh = F.size(F.filter("new", lambda x: x))
        new, total = lists.agg(F.coalesce(F.sum(fresh), F.lit(0)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
        if new <= SETTLED * total:
            break
    if new > SETTLED * total:
        warnings.warn(f"the neighbour graph of {size[0]} nodes has not settled: {new} of {total} neighbours are new in the last round", RuntimeWarning, stacklevel=2)
    beside = _around(lists, neighbours).where("w <> node").dropDuplicates(["w", "node"])
    packed = F.sort_array(F.collect_list(F.struct("node", "code", "scale")))  # at most 2 * neighbours
    graph = settle(beside.groupBy(F.col("w").alias("node")).agg(packed.alias("near")).select("node", F.col("near.node").alias("ids"), F.col("near.code").alias("codes"), F.col("near.scale").alias("scales")))
    discard(lists)
    return Index(nodes, members, graph)


def _expand(frontier: DataFrame, graph: DataFrame) -> DataFrame:
    """What lies next to the frontier (q, code, scale, worst, node): u (the query), v, s, if nearer than the worst that q keeps."""
    joined = frontier.join(graph, "node").select("q", "code", "scale", "worst", "ids", "codes", "scales")

    def run(batches):
        for whole in batches:
            for start in range(0, len(whole), 1_024):
                rows = whole.slice(start, 1_024)
                count = np.diff(rows.column("ids").offsets.to_numpy())
                ids = rows.column("ids").flatten().to_numpy()
                if not len(ids):
                    continue
                near = _decoded(rows.column("codes").flatten(), rows.column("scales").flatten().to_numpy())
                x = np.repeat(_decoded(rows.column("code"), rows.column("scale").to_numpy()), count, axis=0)
                q, worst = (np.repeat(rows.column(c).to_numpy(), count) for c in ("q", "worst"))
                s = -((x - near) ** 2).sum(1)
                keep = s > worst
                yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(ids[keep]), pa.array(s[keep])], names=["u", "v", "s"])

    return joined.mapInArrow(run, "u long, v long, s float")


def search(index: Index, queries: DataFrame, k: int, beam: int | None = None, exact: int = EXACT) -> DataFrame:
    """The k nearest keys of every query (q, vector, start: a node of the graph where its search begins).

    Greedy search: every round expands all candidates among a query's ``beam``
    nearest (``beam_for`` the nodes unless given) that were not expanded before, until none is left; no candidate is
    expanded twice, so a search always ends.  The ``exact``
    nearest are then measured on the original vectors in double precision; ties go
    to the smaller key.  A query's own key is no candidate.  Columns: q, rank, key, score.
    """
    spark = queries.sparkSession
    beam = beam_for(index.nodes.count()) if beam is None else beam
    # every round reads the graph by node: kept dealt by node, only the frontier moves
    graph = spread(index.graph, "node").persist()
    try:

        def coded(batches):
            for batch in batches:
                if len(batch):
                    codes, scale = _codes(matrix(batch.column("vector")))
                    yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("start"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale)], names=["q", "start", "code", "scale"])

        asked = queries.select("q", "start", "vector").mapInArrow(coded, "q long, start long, code binary, scale double")
        lowest = F.array(F.lit(float("-inf")).cast("float"))
        state = stored(asked.select(F.col("q").alias("u"), "code", "scale", F.array("start").alias("ids"), lowest.alias("near"), F.array(F.lit(True)).alias("new")), "search")
        while not (open_ := state.where(F.exists("new", lambda x: x))).isEmpty():
            fresh = F.filter(F.arrays_zip("ids", "new"), lambda x: x["new"])
            frontier = open_.select(F.col("u").alias("q"), "code", "scale", _worst(beam), F.explode(fresh["ids"]).alias("node"))
            before, state = state, stored(_merged(state, _expand(frontier, graph), beam), "search")
            discard(before)
            release(spark)
        near = state.select(F.col("u").alias("q"), F.explode(F.slice("ids", 1, exact)).alias("node"))
        near = near.unionAll(queries.select("q", F.col("start").alias("node"))).distinct()
        pairs = near.join(index.nodes.select("node", F.col("vector").alias("there")), "node").join(queries.select("q", "vector"), "q")
        square = F.aggregate(F.zip_with("vector", "there", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda t, x: t + x)
        measured = pairs.select("q", "node", F.sqrt(square).alias("score"))
        # the first k + 1 keys of equal vectors are enough for k results
        first = Window.partitionBy("node").orderBy("key")
        members = index.members.join(near.select("node").distinct(), "node", "left_semi").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
        hits = measured.join(members.select("node", "key"), "node").where("key <> q")
        order = Window.partitionBy("q").orderBy("score", "key")
        return settle(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "key", "score"))
    finally:
        graph.unpersist()


@query()
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    asked = index.members.where("key % 100 = 0").join(index.nodes, "node").select(F.col("key").alias("q"), "vector", F.col("node").alias("start"))
    found = search(index, settle(asked), 10)
    return found.select(F.col("q").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")
