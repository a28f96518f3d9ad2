"""Language identification with string kernels.

The kernel counts the n-grams (one to three symbols) that two texts share, each once however often it occurs, over the
root of the product of their numbers of n-grams. Landmarks from a bounded, stratified sample of the labelled rows span a
Nyström feature space; one-versus-rest kernel ridge regression is solved in it. Texts are scored in batches: a matrix
of presences times the landmarks' presences gives the kernel rows, times the coefficients the scores. Whole texts count.

Symbols: every letter in lower case, of any script, has its own; white space, digits and all else share three. The n-grams
are hashed into a table of ``COLUMNS`` columns. Parameters of the sample: ``per_language`` rows for each label (by hash of the id), of at most ``max_chars``
characters where there are such rows.

The raw scores of a text sum to 2 - languages, so the largest alone can't tell a foreign text: it never falls below a
bound. What a text must have besides is learned from the sample: the trigrams around its letters (all else is a space)
are looked up among the sample's, and the share that one half of the sample lacks of the other's sets how much a text
may lack (by language). A text that lacks more, or has far fewer letters among its characters than the sample, gets
score 0.

Cases: a null text, or one without any letter, gets ``und`` and score 0; very long texts cost time in proportion; without
any labelled row all texts get ``und``; equal texts get equal results; other columns pass through, except those named
like a result.
"""

from __future__ import annotations

import functools
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_texts

UNDETERMINED = "und"
SPACE, DIGIT, OTHER, FIRST = 0, 1, 2, 3
#: No code point beyond this one is a letter: the planes above have none.
LAST_LETTER = 0x3FFFF
#: Columns that n-grams are hashed into, and cells of the table of trigrams that are in the sample, as powers of two.
COLUMN_BITS, SEEN_BITS = 18, 22
COLUMNS = 1 << COLUMN_BITS
#: Odd multipliers of the symbols of an n-gram by place, and of one-, two- and three-grams.
PLACES = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
KINDS = [np.uint32(x) for x in (0x27D4EB2F, 0x165667B1, 0xD3A2646D)]
RIDGE, TEMPERATURE = 1e-2, 4.0
#: Share of unseen trigrams that any text may have, and times the share that held-out texts of its language have.
LEAST_SLACK, SLACK_TIMES = 0.05, 3.0
#: Unseen trigrams that a short text may have besides, if they are a quarter of its trigrams at most.
UNSEEN = 12
#: Part of the sample's low share of letters that a text must have.
LETTERS_PART = 1 / 3
#: The share of held-out texts that may lie beyond what is taken as their bound.
BEYOND = 0.005


@dataclass
class Model:
    languages: list[str]
    place: np.ndarray  # column of an n-gram -> row of the landmarks, or -1
    landmarks: np.ndarray  # (rows, landmarks): presence over the root of the landmark's number of n-grams
    weights: np.ndarray  # (landmarks + 1, languages)
    seen: np.ndarray  # trigram around a letter -> is in the sample
    slack: np.ndarray  # share of unseen trigrams that a text may have, by language
    least_letters: float  # share of letters among characters that a text must have


@functools.cache
def symbol_table() -> np.ndarray:
    """Code point -> symbol."""
    table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint32)
    every = "".join(map(chr, range(LAST_LETTER + 1)))
    for code, c in enumerate(every):
        if c.isalpha():
            table[code] = FIRST + code
        elif c.isspace():
            table[code] = SPACE
        elif c.isdigit():
            table[code] = DIGIT
    return table


def symbols(text: str) -> np.ndarray:
    return symbol_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]


def grams(text: str) -> np.ndarray:
    """Distinct columns of the n-grams of a text."""
    s = symbols(text)
    seen, shift = np.zeros(COLUMNS, dtype=bool), np.uint32(32 - COLUMN_BITS)
    sums = s * PLACES[0]
    for n in range(3):
        seen[(sums * KINDS[n] + KINDS[n]) >> shift] = True
        if n == 2 or len(s) <= n + 1:
            break
        sums = sums[:-1] + s[n + 1 :] * PLACES[n + 1]
    eights = np.flatnonzero(seen.view(np.uint64))  # most of the table is empty: look closer only where it isn't
    row, at = np.nonzero(seen.reshape(-1, 8)[eights])
    return eights[row] * 8 + at


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def around_letters(text: str) -> tuple[np.ndarray, float]:
    """Distinct trigrams around letters, and the share of letters among the characters.

    Runs of letters and digits that change between them three times or more, such as keys, count as one space.
    """
    s = symbols(text)
    is_letter = s >= FIRST
    share = is_letter.sum() / max(1, (s != SPACE).sum())
    if (digit := s == DIGIT).any():
        part = is_letter | digit
        starts = np.flatnonzero(part & ~np.concatenate([[False], part[:-1]]))
        change = np.zeros(len(s), dtype=np.int32)
        change[1:] = part[1:] & part[:-1] & (digit[1:] != digit[:-1])
        mixed = np.add.reduceat(change, starts) >= 3
        run = np.cumsum(np.bincount(starts, minlength=len(s))) - 1
        is_letter = is_letter & ~(part & mixed[np.maximum(run, 0)])
    s = np.concatenate([[SPACE], np.where(is_letter, s, SPACE), [SPACE]]).astype(np.uint32)
    s = s[np.concatenate([[True], (s[1:] != SPACE) | (s[:-1] != SPACE)])]
    middle = np.flatnonzero(s != SPACE)
    sums = s[middle - 1] * PLACES[0] + s[middle] * PLACES[1] + s[middle + 1] * PLACES[2]
    return np.unique((sums * KINDS[2]) >> np.uint32(32 - SEEN_BITS)), float(share)


def learn_bounds(model: Model, texts: list[str], labels: list[str]) -> None:
    """Set what a text of a learned language has in common with the sample."""
    every = [around_letters(t) for t in texts]
    halves = [np.zeros(1 << SEEN_BITS, dtype=bool) for _ in range(2)]
    # the halves are dealt within each language; equal texts stay in one half
    turn, half = Counter(), {}
    for t, y in zip(texts, labels, strict=True):
        if t not in half:
            half[t] = turn[y] % 2
            turn[y] += 1
    for t, (codes, _) in zip(texts, every, strict=True):
        halves[half[t]][codes] = True
    model.seen = halves[0] | halves[1]
    for k, lang in enumerate(model.languages):
        lacks = [1 - float(halves[1 - half[t]][codes].mean()) for t, y, (codes, _) in zip(texts, labels, every, strict=True) if y == lang and len(codes)]
        model.slack[k] = min(1.0, max(LEAST_SLACK, SLACK_TIMES * float(np.quantile(lacks, 1 - BEYOND)))) if lacks else 1.0
    model.least_letters = LETTERS_PART * float(np.quantile([share for *_, share in every], BEYOND))


def belongs(model: Model, text: str, k: int) -> bool:
    """Whether a text has as much in common with the sample as the texts of language ``k`` have."""
    codes, share = around_letters(text)
    n = len(codes)
    lacks, slack = n - int(model.seen[codes].sum()), model.slack[k] * n
    # a short text may have a key, a name or an address of which the sample has no trigram
    short = min(max(n / 4, min(n / 2, 1)), UNSEEN + slack)
    return share >= model.least_letters and lacks <= max(slack, short)


def fit(texts: list[str], labels: list[str], landmarks: int = 160) -> Model | None:
    kept = [(t, y) for t, y in zip(texts, labels, strict=True) if has_letter(t)]
    if not kept:
        return None
    languages = sorted({y for _, y in kept})
    sets = [grams(t) for t, _ in kept]
    # landmarks in turn from each language, in the order of the sample
    queues = [[i for i, (_, y) in enumerate(kept) if y == lang] for lang in languages]
    chosen = [q[k] for k in range(max(map(len, queues))) for q in queues if k < len(q)][:landmarks]
    place = np.full(COLUMNS, -1, dtype=np.int32)
    every = np.unique(np.concatenate([sets[i] for i in chosen]))
    place[every] = np.arange(len(every))
    marks = np.zeros((len(every), len(chosen)), dtype=np.float32)
    for k, i in enumerate(chosen):
        marks[place[sets[i]], k] = 1 / np.sqrt(len(sets[i]))
    model = Model(languages, place, marks, np.zeros((len(chosen) + 1, len(languages))), np.zeros(0, dtype=bool), np.ones(len(languages)), 0.0)
    learn_bounds(model, *map(list, zip(*kept, strict=True)))
    kernel = kernels(model, sets)
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.hstack([kernel @ root, np.ones((len(kept), 1))])
    goal = np.array([[1.0 if y == lang else -1.0 for lang in languages] for _, y in kept])
    # languages weigh alike, whatever their share of the sample
    share = Counter(y for _, y in kept)
    w = np.array([len(kept) / len(languages) / share[y] for _, y in kept])[:, None]
    ridge = RIDGE * len(kept) * np.eye(features.shape[1])
    ridge[-1, -1] = 1e-9
    solved = np.linalg.solve(features.T @ (w * features) + ridge, features.T @ (w * goal))
    model.weights = np.vstack([root @ solved[:-1], solved[-1:]])
    return model


def kernels(model: Model, sets: list[np.ndarray]) -> np.ndarray:
    """(texts, landmarks) kernel values, by one matrix product."""
    present = np.zeros((len(sets), model.landmarks.shape[0]), dtype=np.float32)
    for i, some in enumerate(sets):
        at = model.place[some]
        present[i, at[at >= 0]] = 1 / np.sqrt(max(1, len(some)))
    return (present @ model.landmarks).astype(np.float64)


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    asked = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
    for start in range(0, len(asked), 256):
        some = asked[start : start + 256]
        kernel = kernels(model, [grams(texts[i]) for i in some])
        raw = kernel @ model.weights[:-1] + model.weights[-1]
        odds = np.exp(TEMPERATURE * (raw - raw.max(axis=1, keepdims=True)))
        share = odds.max(axis=1) / odds.sum(axis=1)
        # at least 1 / languages for any text; ``belongs`` tells those that no language claims
        claim = np.clip((raw.max(axis=1) + 1) / 2, 0, 1)
        for i, k, s in zip(some, raw.argmax(axis=1).tolist(), np.minimum(share, claim).tolist(), strict=True):
            names[i], scores[i] = model.languages[k], s if belongs(model, texts[i], k) else 0.0
    return names, scores


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, max_chars: int, max_labels: int = 200):
    """About ``per_label`` rows for each label: those with the least hashes of the id.

    Counts cover all rows; what comes to the driver is bounded by ``per_label``, ``max_labels`` and ``max_chars``. More
    labels than ``max_labels`` are an error: none is left out.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label")).filter("label IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") <= max_chars).alias("short")).orderBy(F.desc("n"), "label").limit(max_labels + 1).collect()
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels; raise max_labels, or train on some of them")
    if not counts:
        return [], []
    part = F.pmod(F.xxhash64("id"), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    wanted = F.lit(False)
    for r in counts:
        short = r.short > 0
        fits = F.length("text") <= max_chars if short else F.lit(True)
        wanted = wanted | ((F.col("label") == r.label) & fits & (part < 1.2 * per_label / max(1, r.short if short else r.n)))
    got = rows.filter(wanted).orderBy(F.xxhash64("id"), "id").limit(2 * per_label * len(counts)).collect()
    return [r.text for r in got], [r.label for r in got]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 250, max_chars: int = 20_000, landmarks: int = 160) -> Model | None:
    return fit(*sample(docs, id_col, text_col, label_col, per_language, max_chars), landmarks)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1). The model's size is bounded by its landmarks; it is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_texts(docs, text_col, lambda texts: list(predict(sent.value, texts)), fields, docs.columns)
