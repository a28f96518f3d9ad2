r"""SimHash near-deduplication with the generalised pigeonhole principle.

Words are ``[^\x20\x09-\x0D]+`` of the text with A-Z in lower case; shingles are joined by one space, repeats included.
A fingerprint bit is 1 if it is set in over half of the shingles' hashes. Two fingerprints link if their first 64 bits
differ in at most ``radius`` places (and, where wider fingerprints are asked for, if all bits differ in at most
``verify`` places).

Equal fingerprints are one node. Over all nodes the counts of bits and of pairs of bits are taken; correlated bits go
into the same partition, and dynamic programming allots each partition its own threshold, -1 (never probed) or more, so
that they sum to radius - partitions + 1, at the least estimated cost. By the generalised pigeonhole principle any two
fingerprints within the radius then agree, in some partition, within its threshold. Nodes are indexed under their
partition values and probe all values within the threshold; tasks compare what meets, bit by bit, and hand on a spanning
forest of the links, never all pairs of a bucket. A bucket that is too large for one task is cut into blocks, and each
pair of blocks is one task's work, so that no task holds more than two blocks.

Cases: null, empty and white-space-only texts have fingerprint zero and link like any other; fewer words than a shingle
make one shingle of all words; equal rows are separate documents of one node; a null id takes no part in component_id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm.common import body, default_partitions, slices
from tidemark.llm.components import components

BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
#: Costs in the same unit: making, moving and sorting one probe; comparing one pair.
PROBE_COST, PAIR_COST = 1000.0, 2.0
#: Partitions of a 64-bit word at most.
MAX_PARTITIONS = 8
#: Rows of a block of a large bucket, and pairs compared at once.
BLOCK_ROWS, PAIRS_AT_ONCE = 16_384, 1 << 20
#: Pairs that are linked before those that became connected are dropped; nodes that a task keeps links of.
PAIRS_IN_TURN, MOST_PARENTS = 1024, 500_000


def shingles(text: str | None, size: int) -> list[bytes]:
    words = (text or "").encode().lower().split()  # bytes.split() splits at exactly the six ASCII white-space characters
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def hashes(parts: list[bytes], words: int) -> np.ndarray:
    """(shingles, words) unsigned 64-bit hashes. One word: XXH64 with seed 42. More: XXH3 of 128 bits, seeds 42, 43, ..."""
    if words == 1:
        return np.array([xxhash.xxh64_intdigest(x, 42) for x in parts], dtype=np.uint64).reshape(-1, 1)
    columns = [np.frombuffer(b"".join([xxhash.xxh3_128_digest(x, 42 + s) for x in parts]), dtype="<u8").reshape(-1, 2) for s in range((words + 1) // 2)]
    return np.concatenate(columns, axis=1)[:, :words]


def fingerprints(texts: list[str | None], size: int, words: int) -> np.ndarray:
    """(texts, words) fingerprints."""
    out = np.zeros((len(texts), words), dtype=np.uint64)
    for i, text in enumerate(texts):
        if parts := shingles(text, size):
            got = np.ascontiguousarray(hashes(parts, words)).view(np.uint8).reshape(len(parts), -1)
            ones = np.concatenate([np.bincount(got[:, c], minlength=256) @ BITS for c in range(got.shape[1])])
            out[i] = np.packbits(ones * 2 > len(parts), bitorder="little").view(np.uint64)
    return out


def fingerprint_rows(docs: DataFrame, id_col: str, text_col: str, size: int, words: int) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's words as little-endian bytes."""

    def run(batches):
        for part in slices(batches, "text"):
            made = fingerprints(part.column("text").to_pylist(), size, words)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in made], pa.binary())], names=["doc_id", "fp"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), body(text_col).alias("text"))
    return session.arrow_map(texts, run, "doc_id long, fp binary")


# Partitions and thresholds.


def _words(column: pa.Array, words: int) -> np.ndarray:
    """The binary fingerprints of an Arrow column as (rows, words)."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, words)


def bit_counts(nodes: DataFrame, words: int, planned: int = 1) -> tuple[int, np.ndarray]:
    """The number of nodes, and for each pair of bits of each of the first ``planned`` words how many nodes have both set."""
    upper = np.flatnonzero(np.triu(np.ones((64, 64), dtype=bool)).ravel())
    cells = planned * len(upper)

    def run(batches):
        both, n = np.zeros((planned, 64, 64)), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                part = _words(batch.column(0).slice(i, 8192), words)
                for w in range(planned):
                    x = np.unpackbits(np.ascontiguousarray(part[:, w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                    both[w] += x.T @ x
                n += len(part)
        if n:
            flat = np.append(both.reshape(planned, -1)[:, upper].ravel(), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells + 1, dtype=np.int32)), pa.array(flat)], names=["at", "n"])

    got = dict(session.arrow_map(nodes.select("fp"), run, "at int, n long").groupBy("at").agg(F.sum("n")).collect())
    both = np.zeros((planned, 64 * 64))
    both[:, upper] = np.array([got.get(i, 0) for i in range(cells)], dtype=np.float64).reshape(planned, -1)
    both = both.reshape(planned, 64, 64)
    return got.get(cells, 0), np.maximum(both, both.transpose(0, 2, 1))


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each grows from one bit by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    bound = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(bound, 0)
    free, out = np.ones(64, dtype=bool), []
    for k in range(m):
        width = (64 - sum(map(len, out))) // (m - k)
        group = [int(np.where(free, np.where(free, bound, -1.0).max(axis=1), -1.0).argmax())]
        nearest = bound[group[0]].copy()
        free[group[0]] = False
        while len(group) < width:
            group.append(int(np.where(free, nearest, -1.0).argmax()))
            free[group[-1]] = False
            nearest = np.maximum(nearest, bound[group[-1]])
        out.append(sorted(group))
    return out


def pair_shares(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated share of pairs of nodes that differ in at most 0, 1, ..., most of the partition's bits.

    The share that agrees in all bits follows from the shares that agree in two, along a maximum spanning tree.
    """
    n = max(n, 1)
    at = np.ix_(bits, bits)
    p = np.diag(both)[bits] / n
    a = both[at] / n
    agree = np.maximum(p**2 + (1 - p) ** 2, 1e-9)
    gain = (a**2 + (p[:, None] - a) ** 2 + (p[None, :] - a) ** 2 + (1 - p[:, None] - p[None, :] + a) ** 2) / np.outer(agree, agree)
    share, best, left = agree[0], gain[0].copy(), np.ones(len(bits), dtype=bool)
    left[0] = False
    while left.any():
        k = int(np.where(left, best, -1.0).argmax())
        share *= min(1.0, best[k] * agree[k])
        left[k] = False
        best = np.maximum(best, gain[k])
    odds = np.zeros(most + 1)
    odds[0] = 1
    for r in (1 - agree) / agree:
        odds[1:] += odds[:-1] * r
    return np.minimum(1, share * np.cumsum(odds)).tolist()


def allot(n: int, both: np.ndarray, radius: int) -> list[tuple[int, list[int], int]]:
    """The partitions that are probed, (word, bits, threshold): the least estimated cost over all numbers of partitions.

    ``both`` has the counts of each word. A partition lies within one word; the thresholds of all are allotted together.
    """
    n, both = max(n, 1), both.reshape(-1, 64, 64)  # probes have a cost also where there is nothing to probe
    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, MAX_PARTITIONS + 1):
        goal = radius - m * len(both) + 1
        if goal < -m * len(both):
            break
        groups = [(w, bits) for w in range(len(both)) for bits in group_bits(n, both[w], m)]
        most = min(radius, 64 // m + 1, max(0, goal) + 3)
        # cheapest[s]: the least cost of the partitions so far whose thresholds sum to s, and those thresholds
        cheapest: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for w, bits in groups:
            shares, step = pair_shares(n, both[w], bits, radius), {}
            probes = np.cumsum([float(comb(len(bits), t)) for t in range(radius + 1)])
            for s, (cost, chosen) in cheapest.items():
                for t in range(-1, min(most, len(bits)) + 1):
                    more = 0.0 if t < 0 else n * (float(probes[t]) + (t > 0)) * PROBE_COST + float(n) ** 2 * shares[t] * PAIR_COST
                    if cost + more < step.get(s + t, (float("inf"),))[0]:
                        step[s + t] = (cost + more, (chosen, t))
            cheapest = step
        if goal in cheapest and cheapest[goal][0] < best[0]:
            chosen, thresholds = cheapest[goal][1], []
            while chosen:
                chosen, t = chosen
                thresholds.append(t)
            best = (cheapest[goal][0], [(w, g, t) for (w, g), t in zip(groups, thresholds[::-1], strict=True) if t >= 0])
    return best[1]


# Probing and verifying.


def _value(word: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(word), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((word >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out.view(np.int64)


def flips(width: int, most: int) -> np.ndarray:
    """Values to xor with for all changes of 1 to ``most`` bits."""
    return np.array([sum(1 << i for i in some) for k in range(1, most + 1) for some in combinations(range(width), k)], dtype=np.uint64).view(np.int64)


def bucket_rows(nodes: DataFrame, plan: list[tuple[int, list[int], int]], words: int, shown: dict[int, list[int]]) -> DataFrame:
    """(part, value, own, node, c0, ...): each node under its own values and, with own false, under those it probes.

    ``shown`` names the words that a row carries for the comparison, by the word that its partition lies in.
    """
    masks = [flips(len(bits), t) for _, bits, t in plan]
    most = 200_000
    width = len(next(iter(shown.values()), []))
    names = ["part", "value", "own", "node", *[f"c{i}" for i in range(width)]]

    def run(batches):
        for batch in batches:
            step = max(1, most // max(1, *(len(m) for m in masks)))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                fp, node = _words(part.column("fp"), words), part.column("node").to_numpy()
                for k, (w, bits, _) in enumerate(plan):
                    value = _value(fp[:, w], bits)
                    every = np.concatenate([value[:, None], value[:, None] ^ masks[k][None, :]], axis=1)
                    row = np.repeat(np.arange(len(fp)), every.shape[1])
                    own = np.zeros(every.shape, dtype=bool)
                    own[:, 0] = True
                    carried = [pa.array(np.ascontiguousarray(fp[row, c]).view(np.int64)) for c in shown[w]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k, np.int32)), pa.array(every.ravel()), pa.array(own.ravel()), pa.array(node[row]), *carried], names=names)

    return session.arrow_map(nodes.select("node", "fp"), run, "part int, value long, own boolean, node long" + "".join(f", c{i} long" for i in range(width)))


def large_buckets(nodes: DataFrame, plan: list[tuple[int, list[int], int]], words: int, n: int) -> DataFrame:
    """(part, value, blocks) of the buckets that may hold more rows than a block, owners and probes.

    Of such a bucket some share holds its part of a block. Only such parts are handed on; what is missing is bounded.
    """
    masks = [flips(len(bits), t) for _, bits, t in plan]
    most = max(1000, 400_000 // max([1, *(1 + len(m) for m in masks)]))  # nodes of a share
    shares = 1 + nodes.rdd.getNumPartitions() + n // most
    least = max(1, BLOCK_ROWS // (2 * shares))

    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            fp = np.concatenate(held)
            for k, (w, bits, _) in enumerate(plan):
                value = _value(fp[:, w], bits)
                value, times = np.unique(np.concatenate([value[:, None], value[:, None] ^ masks[k][None, :]], axis=1), return_counts=True)
                value, times = value[times >= least], times[times >= least]
                if len(value):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), k, np.int32)), pa.array(value), pa.array(times.astype(np.int64))], names=["part", "value", "n"])

        for batch in batches:
            for i in range(0, batch.num_rows, most):
                held.append(_words(batch.column(0).slice(i, most), words))
                if sum(map(len, held)) >= most:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    counted = session.arrow_map(nodes.select("fp"), run, "part int, value long, n long").groupBy("part", "value").agg((F.sum("n") + F.lit((least - 1) * shares)).alias("n"))
    return counted.filter(F.col("n") > BLOCK_ROWS).select("part", "value", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))


def near_pairs(a: np.ndarray, b: np.ndarray, first: int | None, total: int | None) -> np.ndarray:
    """(a, b) whether rows of words differ in at most ``first`` bits of the first word and in ``total`` bits of all."""
    differ = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    near = np.ones(differ.shape, dtype=bool) if first is None else differ <= first
    if total is not None:
        differ = differ.astype(np.int16)
        for c in range(1, a.shape[1]):
            differ += np.bitwise_count(a[:, None, c] ^ b[None, :, c])
        near &= differ <= total
    return near


class Linker:
    """Links of buckets, as a forest; pairs that earlier links of the task connect aren't compared in full again."""

    def __init__(self, first: int | None, total: int | None, alike=None):
        self.first, self.total, self.alike, self.parent = first, total, alike, {}

    def root(self, node: int) -> int:
        parent = self.parent
        while (up := parent.get(node, node)) != node:
            parent[node] = parent.get(up, up)
            node = up
        return node

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        if not self.parent:
            return nodes
        return np.fromiter(map(self.root, nodes.tolist()), dtype=np.int64, count=len(nodes))

    def links(self, own: np.ndarray, node: np.ndarray, fp: np.ndarray, block: np.ndarray) -> tuple[list[int], list[int]]:
        """New links between rows of which one is an owner; of blocks 0 and 1 only those between the two."""
        out_a, out_b = [], []
        if len(self.parent) > MOST_PARENTS:
            self.parent.clear()
        roots = self.roots(node)
        step = max(1, PAIRS_AT_ONCE // max(1, len(node)))
        cross = block[0] >= 0
        left = np.flatnonzero(block == 0) if cross else np.arange(len(node))
        for i in range(0, len(left), step):
            some = left[i : i + step]
            right = np.flatnonzero(block == 1) if cross else np.arange(some[0], len(node))
            near = near_pairs(fp[some], fp[right], self.first, self.total)
            near &= own[some][:, None] | own[right][None, :]
            near &= roots[some][:, None] != roots[right][None, :]
            x, y = np.nonzero(near)
            x, y = some[x], right[y]
            while len(x):
                # a few at a time: what they connect needs no comparison
                for j, k in zip(x[:PAIRS_IN_TURN].tolist(), y[:PAIRS_IN_TURN].tolist(), strict=True):
                    a, b = int(node[j]), int(node[k])
                    low, high = sorted((self.root(a), self.root(b)))
                    if low != high and (self.alike is None or self.alike(a, b)):
                        self.parent[high] = low
                        out_a.append(high)
                        out_b.append(low)
                x, y = x[PAIRS_IN_TURN:], y[PAIRS_IN_TURN:]
                roots = self.roots(node)
                apart = roots[x] != roots[y]
                x, y = x[apart], y[apart]
        return out_a, out_b


def links(nodes: DataFrame, radius: int, words: int = 1, verify: int | None = None, planned: int = 1, shown: dict[int, list[int]] | None = None, alike=None) -> DataFrame:
    """(a, b): edges with the components of the graph that links nodes (node, fp).

    Partitions lie in the first ``planned`` words; any two nodes whose planned words differ in ``radius`` bits at most
    meet. They link if the first 64 bits differ in ``radius`` bits at most (where one word is planned) and the words shown
    in ``verify`` bits at most, and if ``alike()``, which is called in each task and gives a function of two nodes, holds.
    """
    spark = nodes.sparkSession
    shown = shown or {0: list(range(words))}
    width = len(shown[0])
    n, both = bit_counts(nodes, words, planned)
    plan = allot(n, both, radius)
    rows = bucket_rows(nodes, plan, words, shown)
    large = session.cut(large_buckets(nodes, plan, words, n))
    if large.isEmpty():
        dealt = rows.withColumn("pair", F.lit(0)).withColumn("block", F.lit(-1))
    else:
        # a row of block b meets each block c in the pair of both; pairs of a block with itself are single
        blocks = F.coalesce("blocks", F.lit(1))
        dealt = rows.join(large, ["part", "value"], "left").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("mine", "other"), F.greatest("mine", "other")
        dealt = dealt.withColumn("pair", low * F.col("blocks") + high).withColumn("block", F.when(low == high, -1).otherwise((F.col("mine") == high).cast("int")))
    kept = [f"c{i}" for i in range(width)]

    def run(batches):
        key, held = None, []
        linker = Linker(radius if planned == 1 else None, verify, alike() if alike else None)
        out_a, out_b = [], []

        def bucket():
            own, node, block, fp = (np.concatenate([h[i] for h in held]) if len(held) > 1 else held[0][i] for i in range(4))
            if len(node) > 1 and own.any():
                a, b = linker.links(own, node, fp, block)
                out_a.extend(a)
                out_b.extend(b)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "value", "pair")], axis=1)
            own, node, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "node", "block"))
            fp = np.stack([batch.column(c).to_numpy() for c in kept], axis=1).view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]]).tolist()
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if key is not None and key != (now := tuple(keys[i].tolist())):
                    bucket()
                    held = []
                key = tuple(keys[i].tolist())
                held.append((own[i:j], node[i:j], block[i:j], fp[i:j]))
            if len(out_a) > 200_000:
                yield _edges(out_a, out_b)
                out_a, out_b = [], []
        if held:
            bucket()
        if out_a:
            yield _edges(out_a, out_b)

    dealt = dealt.select("part", "value", "pair", "own", "node", "block", *kept)
    count = max(default_partitions(spark), 1)
    sorted_rows = dealt.repartition(count, "part", "value", "pair").sortWithinPartitions("part", "value", "pair")
    return session.arrow_map(sorted_rows, run, "a long, b long")


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, words: int = 1, verify: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of ``docs``."""
    rows = session.cut(fingerprint_rows(docs, id_col, text_col, shingle, words))
    nodes = session.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("node")).dropna())
    found = components(links(nodes, radius, words, verify))
    of = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(of, "fp", "left").select("doc_id", "fp", "component_id")
