"""Connected components of an undirected graph given as edges, by alternating large-star and small-star steps.

Every step is a join and an aggregate on narrow rows; its result goes to the shared folder, so that a lost executor
costs one step at most. Columns other than a and b are ignored. Tasks first reduce the edges they hold to a spanning forest.

Cases: loops and repeated edges are allowed; null ends are dropped; no edges give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import session

#: Edges that a task gathers before it reduces them.
GATHER = 500_000
#: Into how many parts the edges of one node are dealt where they meet what moves them.
SALTS = 8


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for all nodes but the least ones."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        x, y = label[left], label[right]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if not (apart := low < high).any():
            break
        np.minimum.at(label, high[apart], low[apart])
        while (label != (up := label[label])).any():
            label = up
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def local_forests(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges (a, b), a > b."""

    def run(batches):
        held, size = [], 0

        def reduce():
            a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            return forest(a, b)

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > 2 * GATHER:
                held = [reduce()]
                size = len(held[0][0])
                if size > GATHER:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in reduce()], names=["a", "b"])

    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    return session.arrow_map(pairs, run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (a, b); component is the least node that can be reached.

    A component's least node may have any number of edges. It has no smaller neighbour, so it moves nothing, and edges
    to it need no partner: what moves is joined from a table of the nodes that do, which is dealt ``SALTS`` times.
    """
    now = session.cut(local_forests(edges).distinct())
    seen = None
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS))
    while (mark := now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()) != seen and mark[0]:
        seen = mark
        # large star: every larger neighbour of a node moves to the node's least neighbour
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        moves = least.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("b"), "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        large = session.cut(now.withColumn("salt", salt).join(moves, ["b", "salt"], "left").select("a", F.coalesce("m", "b").alias("b")).distinct())
        # small star: a node's smaller neighbours, and the node, move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        several = large.join(least.filter("n > 1").select("a", "m"), "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = session.cut(several.union(least.select("a", F.col("m").alias("b"))).distinct())
    children = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return children.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
