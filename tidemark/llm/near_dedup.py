"""Near copies by the exact Jaccard similarity of shingles; SimHash's generalised pigeonhole proposes the pairs.

Shingles are runs of ``shingle`` words, as in ``simhash``; repeats don't count. A shingle's hash is a polynomial of its
words' hashes, from which the bits of all ``words`` 64-bit words of the fingerprint are mixed. The bits of each word are
partitioned, and thresholds are allotted over all partitions of all words together, so that any two fingerprints within
``radius`` bits of all meet. Beyond the radius most pairs meet as well: two texts with a similarity of 0.8 differ in
0.15 of the bits and meet in one of 40 partitions of 13 bits with a probability of 0.994, with one of 0.85 in 0.9994.
What meets is compared on two further words (at most ``verify`` of 128 bits; a similarity of 0.8 stays below it but for
one pair in a million) and then by the shingles themselves: pairs link if the Jaccard similarity is ``least`` or more.

Each slice's shingle hashes (32 bits, so that two texts of n shingles have n**2 / 2**32 false matches) go to a file in
the shared folder; a node's number tells the file and the place. Texts of equal shingles are one node. Tasks compare the
pairs of a bucket that aren't connected yet, and hand on a spanning forest.

Cases: null, empty and white-space-only texts have no shingles and are one node; fewer words than a shingle make one
shingle; rows that share an id are one document; a null id takes no part in component_id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm.common import body, filesystem, slices, write_file
from tidemark.llm.components import components
from tidemark.llm.simhash import links

#: A node's number: the partition, its slice and the place in four-byte units.
SLICE_BITS, PLACE_BITS = 12, 31
#: Open files, and shingle hashes that are kept, of a task.
OPEN_FILES, KEPT_HASHES = 64, 4 << 20
#: Hashes of words that a task keeps, and shingles whose bits are counted at once.
KEPT_WORDS, COUNTED_AT_ONCE = 200_000, 1 << 16
LANES = np.uint64(0x0101010101010101)
MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            self[word] = made
        return made


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()  # at exactly the six ASCII white-space characters
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(known) > KEPT_WORDS:
        known.clear()
    h = np.array(list(map(known.__getitem__, words)), dtype=np.uint64)
    if len(h) < size:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], dtype=np.uint64)
    n, total = len(h) - size + 1, np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        total = total * STEP + h[k : k + n]
    return np.unique(_mix(total))


def prints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """(texts, words) fingerprints: bit b is set if it is in over half of a set's hashes, once mixed for each word."""
    sizes = np.array([len(x) for x in sets])
    out = np.zeros((len(sets), words), dtype=np.uint64)
    held, at = [], 0
    some = np.flatnonzero(sizes)
    while at < len(some):
        # as many texts as there are shingles counted at once, one at least
        ends = np.cumsum(sizes[some[at:]])
        n = max(1, int(np.searchsorted(ends, COUNTED_AT_ONCE, side="right")))
        held = some[at : at + n]
        out[held] = _majority([sets[i] for i in held], words)
        at += n
    return out


def _majority(sets: list[np.ndarray], words: int) -> np.ndarray:
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    # runs of at most 255 rows of one text, so that a byte holds the count of a bit
    runs = [np.arange(start, start + size, 255) for start, size in zip(np.cumsum(sizes) - sizes, sizes, strict=True)]
    first = np.cumsum([0, *map(len, runs)][:-1])
    starts = np.concatenate(runs)
    out = np.empty((len(sets), words), dtype=np.uint64)
    for w in range(words):
        mixed = _mix(flat + np.uint64((0x9E3779B97F4A7C15 * (w + 1)) & ((1 << 64) - 1)))
        ones = np.empty((len(sets), 8, 8), dtype=np.int64)  # byte of the word, bit of the byte
        for bit in range(8):
            lanes = np.add.reduceat((mixed >> np.uint64(bit)) & LANES, starts)
            ones[:, :, bit] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        out[:, w] = np.packbits(ones.reshape(len(sets), 64) * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _path(folder: str, node: int) -> str:
    at = node >> PLACE_BITS
    return f"{folder}/{at >> SLICE_BITS}-{at & ((1 << SLICE_BITS) - 1)}"


def print_rows(docs: DataFrame, id_col: str, text_col: str, size: int, words: int, folder: str) -> DataFrame:
    """(doc_id, fp, key, node): key is the same for equal shingles; the shingles are in the node's file."""

    def run(batches):
        part, known = TaskContext.get().partitionId(), WordHashes()
        for k, rows in enumerate(slices(batches, "text")):
            if k >> SLICE_BITS:
                raise ValueError("a partition has too many slices; use more partitions")
            sets = [shingle_hashes(t, size, known) for t in rows.column("text").to_pylist()]
            keys, places, out, at = [], [], [], 0
            for some in sets:
                keys.append(xxhash.xxh3_128_digest(some.tobytes()))
                places.append(((part << SLICE_BITS | k) << PLACE_BITS) | at)
                short = np.unique(some.astype("<u4"))
                out += [np.array([len(short)], dtype="<u4").tobytes(), short.tobytes()]
                at += 1 + len(short)
            write_file(_path(folder, places[0]), b"".join(out))
            made = pa.array([x.tobytes() for x in prints(sets, words)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), made, pa.array(keys, pa.binary()), pa.array(places, pa.int64())], names=["doc_id", "fp", "key", "node"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), body(text_col).alias("text"))
    return session.arrow_map(texts, run, "doc_id long, fp binary, key binary, node long")


class Sets:
    """The shingle hashes of nodes, read from the shared folder; the last ones are kept."""

    def __init__(self, folder: str):
        self.folder, self.files, self.kept, self.size = folder, OrderedDict(), OrderedDict(), 0

    def _file(self, node: int):
        path = _path(self.folder, node)
        if (found := self.files.pop(path, None)) is None:
            fs, local = filesystem(path)
            found = fs.open_input_file(local)
            if len(self.files) >= OPEN_FILES:
                self.files.popitem(last=False)[1].close()
        self.files[path] = found
        return found

    def get(self, node: int) -> np.ndarray:
        if (some := self.kept.pop(node, None)) is None:
            file, at = self._file(node), 4 * (node & ((1 << PLACE_BITS) - 1))
            n = int(np.frombuffer(file.read_at(4, at), dtype="<u4")[0])
            some = np.frombuffer(file.read_at(4 * n, at + 4), dtype="<u4")
            self.size += n
            while self.size > KEPT_HASHES and self.kept:
                self.size -= len(self.kept.popitem(last=False)[1])
        self.kept[node] = some
        return some

    def alike(self, a: int, b: int, least: float) -> bool:
        x, y = self.get(a), self.get(b)
        if min(len(x), len(y)) < least * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= least * (len(x) + len(y) - both) - 1e-9


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 39, words: int = 8, verify: int = 40, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id), one row for each row of ``docs``."""
    spark = docs.sparkSession
    folder = session.shared_path(spark, "shingles")
    rows = session.cut(print_rows(docs, id_col, text_col, shingle, words, folder))
    nodes = session.cut(rows.groupBy("key").agg(F.min("node").alias("node"), F.min_by("fp", "node").alias("fp"), F.min("doc_id").alias("least_id")))
    of = session.cut(rows.select("doc_id", "key").join(nodes.select("key", "node"), "key").select("doc_id", "node"))
    # the words compared first are not that of the partition, whose bits agree anyway
    shown = {w: [(w + 1) % words, (w + 2) % words] for w in range(words)}

    def alike():
        held = Sets(folder)
        return lambda a, b: held.alike(a, b, least)

    found = session.cut(links(nodes, radius, words, verify, planned=words, shown=shown, alike=alike))
    session.remove(spark, folder)
    shared = of.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("c")).filter("b <> c")
    edges = of.join(shared, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b").union(found)
    groups = nodes.join(components(edges), "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component"))
    least_ids = groups.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return of.join(groups.join(least_ids, "component").select("node", "component_id"), "node").select("doc_id", "component_id")
