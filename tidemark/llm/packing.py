"""Best-fit packing of token sequences, improved by swaps.

Texts are tokenized and cut into pieces of at most ``capacity`` tokens. Pieces are dealt evenly to tasks; each task packs
its own by best fit, longest first, and then improves its underfull bins: it moves a document, exchanges one for one, or
two for one, where that fills the receiving bin further and so raises the sum of squared fills, until the giving bins
empty or nothing helps. Bins that stay underfull are broken up and packed again in fewer tasks, round by round, so that
the number of bins doesn't grow with the number of tasks.

Tokens of a white-space-delimited chunk don't depend on what surrounds it, so workers keep the ids of chunks, and of the
words in them, in tables of fixed size and call the tokenizer for new ones only.

Cases: a null or empty text is one piece with the closing id alone; a text longer than a sequence is cut into full pieces
and a rest; equal rows are packed separately; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm.common import Memo, slices

CAPACITY, CLOSING_ID = 4096, 1
#: Pieces that one task packs: what it holds in memory.
TASK_PIECES = 40_000
#: Bins that one document is tried against by a swap. It bounds the search, not what is packed.
TRIED_BINS = 400


class ChunkTokenizer:
    """The tokenizer's ids of texts, chunk by chunk.

    Chunks of printable ASCII and Latin-1 characters, for which the tokenizer's normalizer is lower-casing, are cut by
    its rule for words, and its model is asked for each new word; it is asked for other chunks as a whole.
    """

    #: The vocabulary's rule for words, for lower-case Latin-1 without white space.
    LETTERS, NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
    WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}]+")
    #: Marks that make one word at the end of a chunk.
    MARKS = ".,!?;:%&$*#|-\""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(plain)]
        self.names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.known, self.words = Memo(), Memo()

    def word(self, word: str) -> bytes:
        name = word if word.isascii() else "".join(map(self.names.__getitem__, word.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(name)]).tobytes()

    def chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        # no character beyond Latin-1, nothing unprintable, no special token
        if max(chunk) > 0xC3 or not text.isprintable() or b"<|" in chunk:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        text = text.lower()
        body = text.rstrip(self.MARKS)
        parts = ([body, text[len(body) :]] if len(body) < len(text) else [body]) if body.isalpha() else self.WORDS.findall(text)
        often, known = self.words.often.get, self.words
        return b"".join([often(w) or known.recall(w) or known.add(w, self.word(w)) for w in parts])

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian unsigned 32-bit numbers."""
        chunks = text.encode().split()  # at the six ASCII white-space characters, which no token spans
        found = list(map(self.known.often.get, chunks))
        if None in found:
            recall, add = self.known.recall, self.known.add
            found = [f if f is not None else recall(c) or add(c, self.chunk(c)) for c, f in zip(chunks, found, strict=True)]
        return b"".join(found)


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), one row for each piece."""

    def run(batches):
        for part in slices(batches, "text"):
            coder = tokenizer(vocabulary_path)
            rows: list[list] = [[], [], [], [], []]
            closing = CLOSING_ID.to_bytes(4, "little")
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                some = coder.encode(text or "") + closing
                for k, at in enumerate(range(0, len(some), 4 * capacity)):
                    cut = some[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *[pa.array(r, pa.int64()) for r in rows[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return session.arrow_map(texts, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers, longest first, each into the fullest bin that holds it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if fits := rooms >> need:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > need:
            by_room[room - need].append(b)
            rooms |= 1 << (room - need)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search over the underfull bins; the bins that are left."""
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    if len(bins) <= least:
        return bins
    under = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: fill[b])
    held = {b: sorted((size[i], i) for i in bins[b]) for b in under}
    rooms = sorted((capacity - fill[b], b) for b in under)  # fullest bins first

    def shift(b: int, out: list[tuple[int, int]], new: list[tuple[int, int]]):
        rooms.pop(bisect_left(rooms, (capacity - fill[b], b)))
        for x in out:
            held[b].pop(bisect_left(held[b], x))
        for x in new:
            insort(held[b], x)
        fill[b] += sum(x[0] for x in new) - sum(x[0] for x in out)
        if fill[b] < capacity:
            insort(rooms, (capacity - fill[b], b))

    def give(a: int) -> bool:
        """One step that takes tokens from bin a; true if there was one."""
        for x in reversed(held[a]):
            k = bisect_left(rooms, (x[0], -1))  # the fullest bin with room for it
            while k < len(rooms) and rooms[k][1] == a:
                k += 1
            if k < len(rooms) and fill[rooms[k][1]] + x[0] > fill[a] - 0:
                b = rooms[k][1]
                shift(a, [x], [])
                shift(b, [], [x])
                return True
        largest = held[a][::-1]
        for x in largest:
            for room, b in rooms[:TRIED_BINS]:
                if b == a or fill[b] < fill[a]:
                    continue
                k = bisect_left(held[b], (x[0] - room, -1))  # the smallest that makes place for x
                if k < len(held[b]) and held[b][k][0] < x[0]:
                    y = held[b][k]
                    shift(a, [x], [y])
                    shift(b, [y], [x])
                    return True
        for p, x1 in enumerate(largest[:8]):
            for x2 in largest[p + 1 : 9]:
                both = x1[0] + x2[0]
                for room, b in rooms[:TRIED_BINS]:
                    if b == a or fill[b] < fill[a]:
                        continue
                    k = bisect_left(held[b], (both - room, -1))
                    if k < len(held[b]) and held[b][k][0] < both:
                        y = held[b][k]
                        shift(a, [x1, x2], [y])
                        shift(b, [y], [x1, x2])
                        return True
        return False

    number = len(bins)
    for a in under:
        if fill[a] >= capacity or number <= least:
            continue
        while held[a] and fill[a] < capacity and give(a):
            pass
        if not held[a]:
            rooms.pop(bisect_left(rooms, (capacity - fill[a], a)))
            number -= 1
        elif fill[a] < capacity:
            break  # what is left in the emptiest bin can't be placed
    return [[i for _, i in held[b]] if b in held else bins[b] for b in range(len(bins)) if b not in held or held[b]]


def pack_round(rows: DataFrame, tasks: int, capacity: int, number: int, last: bool) -> DataFrame:
    """Pack in ``tasks`` tasks; the rows of bins that stay underfull have sequence_id null, but not in the last round."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        lengths = table.column("length").to_numpy()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        from pyspark import TaskContext

        base = (number << 56) + (TaskContext.get().partitionId() << 32)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        open_ = np.zeros(len(lengths), bool)
        for k, some in enumerate(bins):
            ends = np.cumsum(lengths[some])
            sequence[some], offset[some] = base + k, ends - lengths[some]
            open_[some] = not last and ends[-1] < capacity - capacity // 64
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield from pa.Table.from_arrays([*[table.column(n) for n in names], pa.array(sequence, mask=open_), pa.array(offset)], names=[*names, "sequence_id", "offset"]).to_batches()

    return session.arrow_map(rows.repartition(tasks), run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of pieces."""
    rows, done, number = session.cut(rows), None, 0
    left = rows.count()
    while True:
        tasks = max(1, -(-left // TASK_PIECES))
        packed = session.cut(pack_round(rows, tasks, capacity, number, last=tasks == 1))
        closed = packed.filter("sequence_id IS NOT NULL")
        done = closed if done is None else done.unionByName(closed)
        if tasks == 1:
            return done
        rows = packed.filter("sequence_id IS NULL").drop("sequence_id", "offset")
        still, number = rows.count(), number + 1
        if still > left // 2:  # most bins can't be filled: another round would change little, so it is the last
            final = session.cut(pack_round(rows, max(1, -(-still // TASK_PIECES)), capacity, number, last=True))
            return done.unionByName(final)
        left = still


def pack_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, vocabulary_path, id_col, text_col, capacity), capacity)
