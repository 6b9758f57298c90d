"""Graph operators over edge tables."""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.joins import join_checked
from siltstone.session import discard, materialize

#: Edges of a contracted graph, whatever the size of the first one, from which on one task finishes.
LAST_EDGES = 20_000


def _undirected(edges: DataFrame, a: Column, b: Column) -> DataFrame:
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def _representatives(edges: DataFrame, seed: int) -> DataFrame:
    """node and to: the first of a node and its neighbours in an order that is drawn anew for each seed."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    place = lambda x: F.struct(F.xxhash64(F.lit(seed), x), x)
    first = both.groupBy("node").agg(F.min_by("other", place(F.col("other"))).alias("to"))
    return first.select("node", F.when(place(F.col("node")) < place(F.col("to")), F.col("node")).otherwise(F.col("to")).alias("to"))


def _contracted(edges: DataFrame, to: DataFrame) -> DataFrame:
    left, right = (to.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
    joined = edges.join(left, "a").join(right, "b")
    return _undirected(joined, F.col("to_a"), F.col("to_b"))


def _finished(edges: DataFrame) -> DataFrame:
    """node and to, the smallest node that edges reach, by union-find in one task; edges has LAST_EDGES at most."""
    kind = edges.schema["a"].dataType.simpleString()

    def work(batches):
        up: dict = {}

        def find(x):
            top = x
            while up.get(top, top) != top:
                top = up[top]
            while up.get(x, x) != top:
                up[x], x = top, up[x]
            return top

        schema = None
        for t in batches:
            schema = t.schema
            for a, b in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
                x, y = sorted((find(a), find(b)))
                up[x], up[y] = x, x
                up.setdefault(a, x), up.setdefault(b, x)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), schema.types[0]), pa.array([find(x) for x in up], schema.types[0])], ["node", "to"])

    return edges.coalesce(1).mapInArrow(work, f"node {kind}, to {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", nodes: DataFrame | None = None, last_edges: int = LAST_EDGES) -> DataFrame:
    """node and component, the smallest node that edges reach, for each node that has an edge and each row of nodes.

    nodes has a column `node`; one without an edge is a component of its own. Null ends are left out.

    Randomised contraction: in each round a node is merged into the first of itself and its neighbours in an order
    drawn by hash, and edges move along. On any graph, long paths in any order included, this leaves 3/4 of the nodes
    that still have edges at most, in the mean, so that the rounds grow with the logarithm of the nodes, all of them
    together do work in proportion to the edges, and no number of rounds is set. Minima are combined before they are
    shuffled, so a node may have any number of edges. Each round is written; only counts go to the driver. A remainder
    of last_edges edges or fewer is finished in one task.
    """
    left = materialize(_undirected(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()), F.col(a), F.col(b)), "edges")
    steps = []
    for seed in count():
        if left.count() <= last_edges:
            break
        to = materialize(_representatives(left, seed), "to")
        before, left = left, materialize(_contracted(left, to), "edges")
        discard(before)
        steps.append(to)
    labels = materialize(_finished(left) if last_edges else left.select(F.col("a").alias("node"), F.col("b").alias("to")), "labels")
    discard(left)
    for to in reversed(steps):
        after = labels.select(F.col("node").alias("to"), F.col("to").alias("root"))
        before, labels = labels, materialize(to.join(after, "to", "left").select("node", F.coalesce("root", "to").alias("to")), "labels")
        discard(before, to)
    if steps:  # a root is any node of its component
        least = materialize(labels.groupBy("to").agg(F.min("node").alias("m")).select("to", F.least("to", "m").alias("component")), "least")
        before, labels = labels, materialize(join_checked(labels, least, ["to"], "inner", 64).select("node", "component"), "components")
        discard(before, least)
    else:
        labels = labels.select("node", F.col("to").alias("component"))
    if nodes is None:
        return labels
    alone = nodes.select("node").where("node IS NOT NULL").distinct().join(labels, "node", "left_anti")
    return labels.union(alone.select("node", F.col("node").alias("component")))
