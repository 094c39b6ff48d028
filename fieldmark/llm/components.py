"""Connected components of a link table, by joins and small aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.session import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node that each linked node reaches: columns node, component.

    Alternates two star steps until nothing changes: every node hangs its larger
    neighbours, then itself and its smaller neighbours, on the smallest node next
    to it.  Neighbour lists are never gathered: a step joins the links with one
    minimum per node, so a node with very many links is split like any large
    key.  Nodes without a link to another node are not returned.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b").distinct()
    edges = settle(edges)
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = settle(small.unionAll(low.select("a", F.col("low").alias("b"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


class Forest:
    """Links of one task's nodes that join parts not yet joined; at most one per node is kept."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, index = np.unique(nodes, return_inverse=True)
        self.index = index
        self.root = np.arange(len(self.nodes))
        self.kept: list[tuple[int, int]] = []

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        """Links between rows, given by their places among the nodes of the start."""
        a, b = self.index[left], self.index[right]
        apart = self.root[a] != self.root[b]
        if not apart.any():
            return
        parent = self.root
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            p, q = x, y
            while parent[p] != p:
                parent[p] = parent[parent[p]]
                p = parent[p]
            while parent[q] != q:
                parent[q] = parent[parent[q]]
                q = parent[q]
            if p != q:
                parent[max(p, q)] = min(p, q)
                self.kept.append((x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        self.root = parent

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = np.array(self.kept).T
        return self.nodes[a], self.nodes[b]
