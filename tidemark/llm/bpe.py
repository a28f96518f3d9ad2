r"""Byte-level BPE through a minimal acyclic transducer of frequent words.

All texts are counted (each task with a lossy counter of fixed size), and about the most frequent words, those above a
bound on their counts that a histogram gives, are compiled into a minimal acyclic automaton: states with equal futures are shared, and each arc knows how many words come before those
beyond it, so that walking a word gives its number and with it its ids. The automaton and its ids are one file in the
shared folder, memory-mapped by the workers. A word that isn't in it is merged by the vocabulary's ranks, so the lexicon
only affects speed. Decoding joins the bytes of the ids.

Texts are first cut before single spaces that stand between other characters, where a word always ends; workers keep the
ids of such chunks, and of words, in tables of fixed size.

Cases: null counts as empty and has no ids; special tokens in a text are found first, as the library does; long words
take O(n log n); equal rows get equal results; an empty table gives an empty result; other columns pass through, except
those named like a result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from array import array
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import session
from tidemark.llm.common import MEMO_LONGEST, Memo, map_file, map_texts, slices, write_file

#: The vocabulary's rule for words; white space is Unicode's.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Two characters of white space together: such texts are cut by the rule alone.
UNEVEN = regex.compile(r"[\s\x1c-\x1f\x85]{2}")
MARKS = ".,!?;:%&$*#|-\""
LEXICON_WORDS, COUNTED, CHUNKS = 65_536, 200_000, 200_000
#: Bits of an id in a packed number; more than any rank.
BITS, UNRANKED = 20, 1 << 60
MASK = (1 << BITS) - 1


class Vocabulary:
    """Ids, ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        names = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        code = lambda token: bytes(names[c] for c in token)
        self.ids = {code(t): i for t, i in spec["model"]["vocab"].items() if all(c in names for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = [(code(a), code(b)) for a, b in pairs]
        self.ranks = {p: r for r, p in enumerate(pairs)}
        #: for two ids side by side, the rank of their pair and the id that they become, in one number
        self.pairs = {self.ids[a] << BITS | self.ids[b]: r << BITS | self.ids[a + b] for r, (a, b) in enumerate(pairs)}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in self.ids.items():
            self.bytes[i] = t
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Join the pair of least rank, leftmost first, until no pair has a rank."""
        if len(word) > 48:
            return self._merge_long([word[i : i + 1] for i in range(len(word))])
        parts, pair = [self.single[b] for b in word], self.pairs.get
        ranks = [pair(a << BITS | b, UNRANKED) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != UNRANKED:
            at = ranks.index(best)
            parts[at : at + 2] = [best & MASK]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = pair(parts[at] << BITS | parts[at + 1], UNRANKED)
            if at:
                ranks[at - 1] = pair(parts[at - 1] << BITS | parts[at], UNRANKED)
        return parts

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        n, ranks = len(parts), self.ranks
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if not live[i] or j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], live[j], after[i] = left + right, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(queue, (r, a, parts[a], parts[b]))
        return [self.ids[parts[i]] for i in range(n) if live[i]]


# The lexicon.


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The file of the automaton over sorted, distinct words, and of their ids."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]  # of the last word: finality and arcs so far

    def close(depth: int):
        """Replace the states of the last word beyond ``depth`` by equal ones that are registered."""
        while len(path) > depth + 1:
            final, arcs = path.pop()
            state = (final, tuple(arcs))
            if (number := register.get(state)) is None:
                number = register[state] = len(states)
                states.append(state)
            label = path[-1][1][-1][0]
            path[-1][1][-1] = (label, number)

    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        for byte in word[common:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    size = [0] * len(states)
    first, labels, target, skip, final = array("I", [0]), bytearray(), array("I"), array("I"), bytearray()
    for number, (is_final, arcs) in enumerate(states):  # a state comes after those that it leads to
        size[number] = int(is_final)
        for label, to in arcs:
            labels.append(label)
            target.append(to)
            skip.append(size[number])
            size[number] += size[to]
        first.append(len(labels))
        final.append(is_final)
    starts = array("I", [0])
    flat = array("I")
    for some in ids:
        flat.extend(some)
        starts.append(len(flat))
    parts = [first.tobytes(), target.tobytes(), skip.tobytes(), starts.tobytes(), flat.tobytes(), bytes(labels), bytes(final)]
    return struct.pack("<7q", *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A mapped lexicon file."""

    def __init__(self, data):
        sizes, at, parts = struct.unpack_from("<7q", data), 56, []
        view = memoryview(data)
        for k, n in enumerate(sizes):
            part = view[at : at + n]
            parts.append(part.cast("I") if k < 5 else bytes(part) if k == 5 else part)
            at += n
        self.first, self.target, self.skip, self.starts, self.flat, self.labels, self.final = parts
        self.root = len(self.final) - 1

    def get(self, word: bytes) -> list[int] | None:
        state, number = self.root, 0
        first, labels, target, skip = self.first, self.labels, self.target, self.skip
        for byte in word:
            arc = labels.find(byte, first[state], first[state + 1])
            if arc < 0:
                return None
            number += skip[arc]
            state = target[arc]
        return self.flat[self.starts[number] : self.starts[number + 1]].tolist() if self.final[state] else None


def chunks(text: str) -> list[str]:
    """Pieces in which words can be found apart; all but the first lack a space that stands before them."""
    return text.split(" ")


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): counts over all texts; a task that meets too many chunks drops the rarest, as lossy counting does."""

    def run(batches):
        found: Counter = Counter()
        for part in slices(batches, "text"):
            for text in part.column("text").to_pylist():
                if text:
                    found.update(chunks(text))
            if len(found) > COUNTED:
                least = sorted(found.values())[len(found) // 2]
                found = Counter({c: n for c, n in found.items() if n > least})
        words: Counter = Counter()
        for chunk, n in found.items():
            if n > 1 and len(chunk) <= MEMO_LONGEST:
                for word in WORDS.findall(" " + chunk):
                    words[word] += n
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    some = session.arrow_map(docs.select(F.col(f"`{text_col}`").alias("text")), run, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text_col: str, vocabulary: Vocabulary, size: int = LEXICON_WORDS) -> str:
    """Count, compile and write the lexicon; returns its place. What comes to the driver is ``size`` words at most in all."""
    counts = session.cut(count_words(docs, text_col))
    # sixteen classes of counts for each power of two: a few hundred rows, whatever the size of the corpus
    level = F.floor(F.log2("n") * 16)
    least, above = None, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if (above := above + r["count"]) > size:
            break
        least = r.level
    top = [] if least is None else counts.filter(level >= least).select("word").collect()
    words = sorted(r.word.encode() for r in top)
    path = session.shared_path(docs.sparkSession, "lexicon")
    write_file(path, compile_lexicon(words, [vocabulary.merge(w) for w in words]))
    return path


class Encoder:
    """Ids of texts, as packed unsigned 32-bit numbers."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.spaced, self.plain = Memo(CHUNKS), Memo(CHUNKS)

    def word(self, word: str) -> bytes:
        raw = word.encode()
        ids = self.lexicon.get(raw) if self.lexicon else None
        return array("I", self.vocabulary.merge(raw) if ids is None else ids).tobytes()

    def _word(self, word: str) -> bytes:
        return self.plain.get(word) or self.plain.add(word, self.word(word))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk with a space before it."""
        body = chunk.rstrip(MARKS)
        if body.isalpha() and chunk.isascii():  # letters, and perhaps marks: the rule gives these two
            return self._word(" " + body) + self._word(chunk[len(body) :]) if len(body) < len(chunk) else self._word(" " + body)
        return b"".join(map(self._word, WORDS.findall(" " + chunk)))

    def _ordinary(self, text: str) -> bytes:
        if UNEVEN.search(text):
            return b"".join(map(self._word, WORDS.findall(text)))
        head, *rest = chunks(text)
        found = list(map(self.spaced.often.get, rest))
        if None in found:
            recall, add = self.spaced.recall, self.spaced.add
            found = [f if f is not None else recall(c) or add(c, self._chunk(c)) for c, f in zip(rest, found, strict=True)]
        return b"".join([*map(self._word, WORDS.findall(head)), *found])

    def encode(self, text: str) -> bytes:
        if self.vocabulary.cut is None or not any(s in text for s in self.vocabulary.special):
            return self._ordinary(text) if text else b""
        parts = self.vocabulary.cut.split(text)
        return b"".join(struct.pack("<I", self.vocabulary.special[p]) if i % 2 else self._ordinary(p) for i, p in enumerate(parts) if p)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.bytes.__getitem__, array("I", ids))).decode("utf-8", "replace")


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary_path: str, lexicon_path: str) -> Encoder:
    if (key := (vocabulary_path, lexicon_path)) not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(vocabulary_path), Lexicon(map_file(lexicon_path)))
    return _encoders[key]


def bpe_encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", lexicon_words: int = LEXICON_WORDS, with_ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids (packed little-endian unsigned 32-bit numbers) and decoded; without ids only digests."""
    lexicon = build_lexicon(docs, text_col, Vocabulary(vocabulary_path), lexicon_words)
    fields = [T.StructField("n_tokens", T.LongType())]
    if with_ids:
        fields += [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    else:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(texts):
        coder = encoder(vocabulary_path, lexicon)
        n, first, second = [], [], []
        for text in texts:
            ids = coder.encode(text or "")
            decoded = coder.decode(ids)
            n.append(len(ids) // 4)
            first.append(ids if with_ids else hashlib.sha256(ids).hexdigest())
            second.append(decoded if with_ids else hashlib.sha256(decoded.encode()).hexdigest())
        return [n, first, second]

    return map_texts(docs, text_col, run, fields, docs.columns)
