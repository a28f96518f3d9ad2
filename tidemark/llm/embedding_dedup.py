"""Near-duplicate vectors by an epsilon grid order join.

Cosine >= c is distance <= epsilon = sqrt(2 - 2 c) between unit vectors. Equal vectors are one node. Nodes are projected
on the leading principal directions of all vectors, cut into grid cells of side epsilon and sorted in the order of the
cells. The sequence is dealt to tasks by range and written to the shared folder in blocks, each with its bounding box in
the principal directions, and of the length of what lies outside of them. Intervals of the sequence are joined recursively, coarse ones first: a pair of intervals
whose boxes are farther apart than epsilon is skipped with all it contains (a projection never lengthens a distance).
The pairs of blocks that remain are dealt in square tiles, so that a task reads a block once for a side of a tile, and are
compared by matrix products in double precision on the mapped files; what leaves a task is a spanning forest of the links,
and for each node the sum of the rows that it links with.

Cases: null, zero, non-finite vectors, and vectors with such or null components, link with nothing; a shorter vector
counts as padded with zeros; equal vectors link; equal rows are separate vectors; rows with a null id link with nothing
and have no component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm.common import default_partitions, map_file, write_file
from tidemark.llm.components import components, forest

#: Vectors of a block; vectors that one task sorts and writes.
BLOCK, TASK_VECTORS = 1024, 16_384
#: Principal directions of the grid order, and of the bounding boxes; dimensions that they are found in.
CELL_DIMS, BOX_DIMS, PRINCIPAL_OF = 4, 16, 256
#: Children of an interval, as a power of two.
FAN = 5
#: Blocks of a tile's side, as a power of two; bytes of blocks that a task keeps open.
TILE, KEPT_BYTES = 3, 64 << 20
#: By how much a box is wider than its vectors.
ROUNDING = 1e-7


def read_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): v has the components as doubles, or is null for a vector that can't link."""

    def run(batches):
        for batch in batches:
            column = batch.column("v")
            made = []
            for some in column:
                values = some.as_py()
                if values is None or None in values:
                    made.append(None)
                    continue
                x = np.array(values, dtype=np.float64) + 0.0  # -0.0 becomes 0.0
                norm = float(np.sqrt(x @ x))
                made.append(x.tobytes() if len(x) and np.isfinite(x).all() and norm > 0 and np.isfinite(norm) else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(made, pa.binary())], names=["vec_id", "v"])

    return session.arrow_map(rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")), run, "vec_id long, v binary")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors, padded with zeros."""
    values = column.to_pylist()
    out = np.zeros((len(values), dims))
    for i, v in enumerate(values):
        x = np.frombuffer(v)
        out[i, : len(x)] = x
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def principal(nodes: DataFrame, dims: int) -> np.ndarray:
    """(dims, BOX_DIMS) orthonormal leading directions of all nodes; only sums come to the driver."""
    d = min(dims, PRINCIPAL_OF)

    def run(batches):
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.hstack([matrix(batch.column(0), dims)[:, :d], np.ones((batch.num_rows, 1))])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "x"])

    got = session.arrow_map(nodes.select("v"), run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((d + 1) ** 2)
    for r in got:
        total[r["at"]] = r["x"]
    total = total.reshape(d + 1, d + 1)
    n = max(1.0, total[-1, -1])
    mean = total[-1, :-1] / n
    _, vectors = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    out = np.zeros((dims, min(BOX_DIMS, d)))
    out[:d] = vectors[:, ::-1][:, : out.shape[1]]
    return out


def write_blocks(nodes: DataFrame, directions: np.ndarray, epsilon: float, folder: str, total: int) -> DataFrame:
    """Sort by grid cells and write; (block, lo0.., hi0..): block is the task's number and the block's in it."""
    dims, k = directions.shape
    sides = k + 1
    cells = [f"c{i}" for i in range(min(CELL_DIMS, k))]

    def place(batches):
        for batch in batches:
            at = np.floor(matrix(batch.column("v"), dims) @ directions[:, : len(cells)] / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(at[:, i])) for i in range(len(cells))], *[batch.column(c) for c in ("node", "n", "v")]], names=[*cells, "node", "n", "v"])

    def write(batches):
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        task, table = TaskContext.get().partitionId(), pa.Table.from_batches(got)
        names, boxes = [], []
        for i in range(0, table.num_rows, BLOCK):
            part = table.slice(i, BLOCK)
            x = matrix(part.column("v"), dims)
            block = (task << 20) + i // BLOCK
            write_file(f"{folder}/{block}", b"".join(a.tobytes() for a in (np.array([len(x), dims]), part.column("node").to_numpy(), part.column("n").to_numpy(), x)))
            at = x @ directions
            # two rests are at least as far apart as their lengths differ; a little wider, for rounding
            rest = np.sqrt(np.maximum(0, 1 - (at * at).sum(axis=1)))[:, None]
            at = np.hstack([at, rest])
            names.append(block)
            boxes.append(np.concatenate([at.min(axis=0) - ROUNDING, at.max(axis=0) + ROUNDING]))
        boxes = np.array(boxes)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *[pa.array(np.ascontiguousarray(boxes[:, i])) for i in range(2 * sides)]], names=["block", *[f"lo{i}" for i in range(sides)], *[f"hi{i}" for i in range(sides)]])

    kinds = ", ".join(f"{c} int" for c in cells)
    placed = session.cut(session.arrow_map(nodes.select("node", "n", "v"), place, f"{kinds}, node long, n long, v binary"))
    dealt = placed.repartitionByRange(max(1, -(-total // TASK_VECTORS)), *cells, "node").sortWithinPartitions(*cells, "node")
    edges = ", ".join(f"{e}{i} double" for e in ("lo", "hi") for i in range(sides))
    return session.cut(session.arrow_map(dealt, write, f"block long, {edges}"))


def near_blocks(blocks: DataFrame, epsilon: float, k: int) -> DataFrame:
    """(i, j), i <= j: the pairs of blocks that may hold a link, by joining intervals from coarse to fine."""
    spark = blocks.sparkSession
    top = blocks.agg(F.max("block")).first()[0]
    shifts = [0, 20]  # an interval of a level is a block's number without its last bits
    while top is not None and top >> shifts[-1] > 0:
        shifts.append(shifts[-1] + FAN)
    edges = [F.min(f"lo{d}").alias(f"lo{d}") for d in range(k)] + [F.max(f"hi{d}").alias(f"hi{d}") for d in range(k)]
    pairs = spark.createDataFrame([(0, 0)], "i long, j long")
    limit = epsilon**2 * (1 + 1e-9) + 1e-12
    for up, down in zip(shifts[:0:-1], shifts[-2::-1], strict=True):
        level = blocks.groupBy(F.shiftright("block", down).alias("id")).agg(*edges) if down else blocks.withColumnRenamed("block", "id")
        level = level.withColumn("parent", F.shiftright("id", up - down))
        a, b = (level.select(*[F.col(c).alias(f"{side}_{c}") for c in level.columns]) for side in "ab")
        gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo{d}") - F.col(f"b_hi{d}"), F.col(f"b_lo{d}") - F.col(f"a_hi{d}")), 2) for d in range(k))
        found = pairs.join(a, F.col("i") == F.col("a_parent")).join(b, F.col("j") == F.col("b_parent")).filter("a_id <= b_id").filter(gap <= limit)
        pairs = found.select(F.col("a_id").alias("i"), F.col("b_id").alias("j"))
    return pairs


class Blocks:
    """Blocks of the shared folder; those used last stay open, up to a number of bytes and two at least."""

    def __init__(self, folder: str):
        self.folder, self.kept, self.size = folder, OrderedDict(), 0

    def get(self, block: int):
        if (found := self.kept.pop(block, None)) is None:
            data = map_file(f"{self.folder}/{block}")
            n, dims = np.frombuffer(data, dtype=np.int64, count=2).tolist()
            ids, counts = np.frombuffer(data, dtype=np.int64, count=2 * n, offset=16).reshape(2, n)
            found = ids, counts, np.frombuffer(data, offset=16 + 16 * n).reshape(n, dims)
            self.size += found[2].nbytes
            while self.size > KEPT_BYTES and len(self.kept) > 1:
                self.size -= self.kept.popitem(last=False)[1][2].nbytes
        self.kept[block] = found
        return found


def compare_blocks(pairs: DataFrame, folder: str, cosine: float) -> DataFrame:
    """(kind, a, b): kind 0, a links with b rows; kind 1, an edge of the spanning forest."""

    def run(batches):
        blocks = Blocks(folder)
        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (ids, n, x), (ids2, n2, x2) = blocks.get(i), blocks.get(j)
                near = x @ x2.T >= cosine
                if i == j:
                    np.fill_diagonal(near, False)
                rows, columns = np.nonzero(near)
                if not len(rows):
                    continue
                parts = [(ids, near @ n2)] + ([] if i == j else [(ids2, n @ near)])
                some, sums = (np.concatenate(c) for c in zip(*[(a[s > 0], s[s > 0]) for a, s in parts], strict=True))
                a, b = forest(ids[rows], ids2[columns])
                kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(a), np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([some, a])), pa.array(np.concatenate([sums, b]))], names=["kind", "a", "b"])

    tiles = [F.shiftright("i", TILE), F.shiftright("j", TILE), F.col("i"), F.col("j")]
    dealt = session.cut(pairs).repartitionByRange(max(default_partitions(pairs.sparkSession), 8), *tiles).sortWithinPartitions(*tiles)
    return session.arrow_map(dealt, run, "kind int, a long, b long")


def embedding_groups(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``rows``."""
    spark = rows.sparkSession
    epsilon = float(np.sqrt(2 - 2 * cosine))
    vectors = session.cut(read_vectors(rows, id_col, vector_col).withColumn("key", F.unhex(F.sha2("v", 256))))
    usable = vectors.filter("v IS NOT NULL AND vec_id IS NOT NULL")
    nodes = session.cut(usable.groupBy("key", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")))
    total, size = nodes.agg(F.count(F.lit(1)), F.max(F.octet_length("v"))).first()
    if not total:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    directions = principal(nodes, size // 8)
    folder = session.shared_path(spark, "grid-order")
    blocks = write_blocks(nodes, directions, epsilon, folder, total)
    found = session.cut(compare_blocks(near_blocks(blocks, epsilon, directions.shape[1] + 1), folder, cosine))
    sums = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    groups = components(found.filter("kind = 1").select("a", "b"))
    of = nodes.join(sums, "node", "left").join(groups, "node", "left").select("key", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    joined = vectors.select("vec_id", F.when(F.col("v").isNotNull() & F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(of, "key", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
