r"""Line deduplication: a sharded minimal perfect hash over distinct line hashes.

A line's key is the line without ``[\x20\x09-\x0D]`` at its ends and with A-Z in lower case; its hash is 128 bits. Tasks
count, for each hash, the documents that hold it (once a document, combined before the shuffle). Hashes of lines that
recur go to shards; one task builds each shard's minimal perfect hash and the two arrays it indexes, the fingerprint (the
other 64 bits) and the count, and writes them as one file to the shared folder. Lines of fewer documents than the least
number are not indexed: they can't be dropped, and a probe of one ends at a fingerprint that differs. Documents probe the
mapped arrays; lines are never joined. Every shard has a file, also one without lines, that begins with its own size: a
shard that is missing or cut short is an error.

Cases: a null or empty text is one empty line; an empty key is never dropped (fewer code points than ``min_chars``); a
document whose lines all go keeps the empty text; a line repeated within one document counts once for it; equal rows
count as separate documents; an empty table gives an empty result; other columns pass through, except that ``text_col``,
n_lines and n_dropped hold the result.
"""

from __future__ import annotations

import struct
from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import session
from tidemark.llm.common import map_file, map_texts, slices, write_file

#: Distinct hashes of one shard: what one task holds in memory to build it.
SHARD_KEYS = 250_000
#: Distinct hashes that a task counts before it hands them on.
FLUSH_KEYS = 200_000
#: Bytes of shards that a worker keeps, and what a mapped one counts for.
KEPT_BYTES, MAPPED_COST = 128 << 20, 64 << 10
LEVELS = 40
GAMMA = 1.6
LEAST = 2
MASK = (1 << 64) - 1


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text, and their keys. bytes.strip() strips exactly the six ASCII white-space characters."""
    lines = (text or "").encode().split(b"\n")
    return lines, [x.strip().lower() for x in lines]


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def count_lines(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, n): in how many documents each line hash is."""

    def run(batches):
        found: Counter = Counter()

        def flush():
            got = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, 0])), pa.array(np.ascontiguousarray(got[:, 1])), pa.array(list(found.values()), pa.int64())], names=["h1", "h2", "n"])

        for part in slices(batches, "text"):
            for text in part.column("text").to_pylist():
                found.update({xxhash.xxh3_128_digest(k) for k in set(line_keys(text)[1]) if _long(k, min_chars)})
                if len(found) >= FLUSH_KEYS:
                    yield flush()
                    found.clear()
        if found:
            yield flush()

    some = session.arrow_map(docs.select(F.col(f"`{text_col}`").alias("text")), run, "h1 long, h2 long, n long")
    return some.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


# The minimal perfect hash: at each level a key claims a bit; keys alone on their bit stay there, the rest go on.


def _spread(h1: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = h1.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) % np.uint64(bits)


#: A shard's file begins with a mark, its own size, and the sizes of its parts.
MAGIC, HEAD = 0x6D70682D6C696E65, f"<6q{LEVELS}q"


def build_shard(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> bytes:
    """The shard's file. Keys with equal h1 can't be told apart by levels; they go to the explicit tail."""
    h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64)
    left, levels, place, base = np.arange(len(h1)), [], np.full(len(h1), -1, dtype=np.int64), 0
    for level in range(LEVELS):
        if not len(left):
            break
        bits = (int(len(left) * GAMMA) // 64 + 1) * 64
        at = _spread(h1[left], level, bits)
        alone = np.bincount(at, minlength=bits) == 1
        fits = alone[at]
        rank = np.cumsum(alone) - 1
        place[left[fits]] = base + rank[at[fits]]
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        base += int(alone.sum())
        left = left[~fits]
    prints, sums = np.zeros(base, dtype=np.uint64), np.zeros(base, dtype=np.uint32)
    done = place >= 0
    prints[place[done]] = h2[done]
    sums[place[done]] = np.minimum(counts[done], 0xFFFFFFFF)
    words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
    ranks = np.zeros(len(words) + 1, dtype=np.uint64)
    ranks[1:] = np.cumsum(np.bitwise_count(words))
    tail = [h1[left], h2[left], counts[left].astype(np.uint64)]
    rest = b"".join(x.tobytes() for x in (words, ranks, prints, *tail, sums))
    return struct.pack(HEAD, MAGIC, struct.calcsize(HEAD) + len(rest), len(words), base, len(left), len(levels), *[len(x) for x in levels], *[0] * (LEVELS - len(levels))) + rest


class Shard:
    """A shard's file, mapped; ``count`` looks up many hashes at once."""

    def __init__(self, data):
        at = struct.calcsize(HEAD)
        magic, size, words, n, tail, levels, *sizes = struct.unpack_from(HEAD, data) if len(data) >= at else [0] * (6 + LEVELS)
        if magic != MAGIC or size != len(data):
            raise ValueError("a shard's file is damaged")
        self.sizes = sizes[:levels]
        parts = []
        for size, kind in ((words, "<u8"), (words + 1, "<u8"), (n, "<u8"), (tail, "<u8"), (tail, "<u8"), (tail, "<u8"), (n, "<u4")):
            parts.append(np.frombuffer(data, dtype=kind, count=size, offset=at))
            at += parts[-1].nbytes
        self.words, self.ranks, self.prints, self.tail1, self.tail2, self.tail_n, self.sums = parts

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """How many documents hold each hash; 0 where it isn't in the shard."""
        found, left, base = np.zeros(len(h1), dtype=np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _spread(h1[left], level, size * 64)
            word, bit = base + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            bits = self.words[word]
            here = (bits >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[here] & ((np.uint64(1) << bit[here]) - np.uint64(1)))
            index = self.ranks[word[here]].astype(np.int64) + below
            same = self.prints[index] == h2[left[here]]
            found[left[here][same]] = self.sums[index[same]]
            left, base = left[~here], base + size
        for i in left if len(self.tail1) else ():
            same = (self.tail1 == h1[i]) & (self.tail2 == h2[i])
            found[i] = int(self.tail_n[same].max()) if same.any() else 0
        return found


def build_index(counts: DataFrame, folder: str) -> int:
    """Write the shards; returns how many there are."""
    counts = session.cut(counts)
    shards = max(1, -(-counts.count() // SHARD_KEYS))

    def run(batches):
        rows = [np.stack([b.column(i).to_numpy() for i in range(3)]) for b in batches if b.num_rows]
        got = np.concatenate(rows, axis=1) if rows else np.zeros((3, 0), np.int64)
        shard = got[1].astype(np.uint64) % np.uint64(shards)
        for s in np.unique(shard).tolist():
            h1, h2, n = got[:, (shard == s)]
            h1, h2, n = h1[n > 0], h2[n > 0], n[n > 0]
            write_file(f"{folder}/shard-{s}", build_shard(h1, h2, n))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64())], names=["shard"])

    # h2 mod the number of shards, as an unsigned number
    shard = F.expr(f"pmod(pmod(h2, {shards}L) + IF(h2 < 0, {(1 << 64) % shards}L, 0L), {shards}L)")
    # a row without a count for each shard, so that each has a file
    marks = counts.sparkSession.range(shards).select(F.lit(0).cast("long").alias("h1"), F.col("id").alias("h2"), F.lit(0).cast("long").alias("n"))
    dealt = counts.select("h1", "h2", "n").union(marks).repartition(shards, shard)
    session.arrow_map(dealt, run, "shard long").write.format("noop").mode("overwrite").save()
    return shards


_shards: OrderedDict[str, Shard] = OrderedDict()


def _shard(folder: str, s: int) -> Shard:
    """The shard, mapped, or read where the folder isn't mounted; the shards read last are kept, up to a bound of bytes."""
    path = f"{folder}/shard-{s}"
    if (found := _shards.pop(path, None)) is None:
        found = Shard(data := map_file(path))
        found.held = len(data) if isinstance(data, bytes) else MAPPED_COST
        while _shards and sum(x.held for x in _shards.values()) + found.held > KEPT_BYTES:
            _shards.popitem(last=False)
    _shards[path] = found
    return found


def probe(texts: list[str | None], folder: str, shards: int, min_docs: int, min_chars: int) -> list[list]:
    """The kept text, the lines and the dropped lines of each text."""
    split = [line_keys(t) for t in texts]
    every = [k for _, keys in split for k in keys]
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, every)), dtype="<u8").reshape(-1, 2)
    h1, h2 = np.ascontiguousarray(hashes[:, 0]), np.ascontiguousarray(hashes[:, 1])
    counts, of = np.zeros(len(every), dtype=np.int64), h2 % np.uint64(shards)
    order = np.argsort(of, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else ():
        counts[part] = _shard(folder, int(of[part[0]])).count(h1[part], h2[part])
    drop = (counts >= min_docs).tolist()
    if min_docs <= 1:
        drop = [True] * len(every)
    kept, sizes, gone, at = [], [], [], 0
    for lines, keys in split:
        marks = [d and _long(k, min_chars) for d, k in zip(drop[at : at + len(keys)], keys, strict=True)]
        at += len(keys)
        kept.append(b"\n".join([x for x, m in zip(lines, marks, strict=True) if not m]).decode())
        sizes.append(len(lines))
        gone.append(sum(marks))
    return [kept, sizes, gone]


def line_dedup(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the kept text in ``text_col``, and n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    folder = session.shared_path(spark, "line-hash")
    counts = count_lines(docs, text_col, max(1, min_chars)).filter(F.col("n") >= max(LEAST, min_docs))
    shards = build_index(counts, folder)
    chars = max(1, min_chars)
    fields = [T.StructField(text_col, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return map_texts(docs, text_col, lambda texts: probe(texts, folder, shards, min_docs, chars), fields, docs.columns)
