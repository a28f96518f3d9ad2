"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's unary score is linear in its own features and those of its neighbours; a 2 x 2 matrix
scores transitions. Forward-backward gives each line's marginal of being good; a document's quality is the mean marginal
weighted by line length, put through a logistic curve fitted to the training labels.

Only documents are labelled. Training starts with all lines of a document carrying its label, then relabels once: lines of
bad documents that the model holds good become good, save the worst one. The sample is bounded by ``per_label`` documents
of each label (by hash of the id), of at most ``max_chars`` characters where the label has such.

Cases: null counts as empty; a text without lines is one empty line and is scored like any other; very long texts take
time in proportion; without labels all scores are 0.5; equal texts get equal scores; other columns pass through, except
those named like a result.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import session
from tidemark.llm.common import map_texts

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
MARKS = b"!\"#$%&*+/:;<=>?@[\\]^_`{|}~"
FEATURES = 10
BLOCK_LINES = 16_384
CELLS = 400_000  # (lines x documents) of a padded block
THRESHOLD = 0.3


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line, and its length in bytes. Blocks of lines become arrays, which are a tenth the size."""
    blocks, out, sizes, before = [], [], array("q"), None
    for line in (text or "").encode().split(b"\n"):
        n = len(line)
        words = line.split()
        k = len(words)
        per = 1 / max(1, n)
        out.append(
            (
                np.log1p(n) / 8,
                (n - len(line.translate(None, UPPER))) * per,
                (n - len(line.translate(None, MARKS))) * per,
                (n - len(line.translate(None, DIGITS))) * per,
                len(set(words)) / k if k else 1.0,
                min(2.0, sum(map(len, words)) / k / 10) if k else 0.0,
                1.0 if k < 4 else 0.0,
                1.0 if line.rstrip()[-1:] in (b".", b"?") else 0.0,
                1.0 if n == 0 else 0.0,
                1.0 if line == before else 0.0,
            )
        )
        sizes.append(n + 1)
        before = line
        if len(out) == BLOCK_LINES:
            blocks.append(np.array(out))
            out = []
    return np.concatenate([*blocks, np.array(out).reshape(-1, FEATURES)]), np.frombuffer(sizes, dtype=np.int64)


def with_neighbours(own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (zero beyond an end), and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = 0
    after[last] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1))])


def marginals(unary: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected transitions of all chains. unary: log odds of good, chain after chain."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    good, pairs = np.empty(len(unary)), np.zeros((2, 2))
    move = np.exp(np.clip(trans, -20, 20))
    order, at = np.argsort(-lengths, kind="stable"), 0
    while at < len(order):
        most = int(lengths[order[at]])
        some = order[at : at + max(1, CELLS // max(1, most))]
        at += len(some)
        size = lengths[some]
        live = np.searchsorted(-size, -np.arange(1, most + 1), side="right")  # chains with more than t lines
        fore, back = np.empty((most, len(some), 2)), np.ones((most, len(some), 2))
        emit = np.ones((most, len(some), 2))
        for t in range(most):
            n = live[t]
            emit[t, :n, 1] = np.exp(np.clip(unary[starts[some[:n]] + t], -30, 30))
            now = emit[t, :n] if t == 0 else emit[t, :n] * (fore[t - 1, :n] @ move)
            fore[t, :n] = now / now.sum(axis=1, keepdims=True)
        for t in range(most - 2, -1, -1):
            n = live[t + 1]
            now = (emit[t + 1, :n] * back[t + 1, :n]) @ move.T
            back[t, :n] = now / now.sum(axis=1, keepdims=True)
        for t in range(most):
            n = live[t]
            both = fore[t, :n] * back[t, :n]
            good[starts[some[:n]] + t] = both[:, 1] / both.sum(axis=1)
            if t:
                joint = fore[t - 1, :n, :, None] * move[None] * (emit[t, :n] * back[t, :n])[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return good, pairs


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float


def _chains(texts: list[str | None]):
    every, sizes = zip(*map(line_features, texts), strict=True)
    lengths = np.array(list(map(len, sizes)), dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.concatenate(every), np.concatenate(sizes).astype(np.float64), lengths, ends - lengths, ends - 1


def _climb(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, first: np.ndarray, share: np.ndarray, steps: int = 120):
    """Weights and transitions that maximise the penalised likelihood of the line labels, by Adam."""
    weights, trans = np.zeros(x.shape[1]), np.array([[0.5, -0.5], [-0.5, 0.5]])
    follows = np.ones(len(y), dtype=bool)
    follows[first] = False
    seen = np.zeros((2, 2))
    i = np.flatnonzero(follows)
    np.add.at(seen, (y[i - 1].astype(int), y[i].astype(int)), 1)
    m = v = np.zeros(x.shape[1] + 4)
    for step in range(1, steps + 1):
        good, pairs = marginals(x @ weights, lengths, trans)
        slope = np.concatenate([x.T @ (share * (y - good)) / share.sum() - 1e-3 * weights, ((seen - pairs) / max(1, len(i)) - 1e-2 * trans).ravel()])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, trans = weights + move[:-4], trans + move[-4:].reshape(2, 2)
    return weights, trans


def _mean(good: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each chain."""
    return np.add.reduceat(good * sizes, first) / np.add.reduceat(sizes, first) if len(lengths) else np.zeros(0)


def fit(texts: list[str | None], labels: list[int]) -> Model | None:
    if len(set(labels)) < 2:
        return None
    own, sizes, lengths, first, last = _chains(texts)
    mean, spread = own.mean(axis=0), own.std(axis=0) + 1e-3
    x = with_neighbours((own - mean) / spread, first, last)
    doc = np.array(labels, dtype=np.float64)
    y = np.repeat(doc, lengths)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    weights, trans = _climb(x, y, lengths, first, share)
    good, _ = marginals(x @ weights, lengths, trans)
    for i in np.flatnonzero(doc == 0):
        part = slice(first[i], last[i] + 1)
        y[part] = good[part] >= 0.5
        y[first[i] + int(good[part].argmin())] = 0
    weights, trans = _climb(x, y, lengths, first, share)
    good, _ = marginals(x @ weights, lengths, trans)
    z = _mean(good, sizes, lengths, first)
    slope, offset = 4.0, -2.0
    for _ in range(50):  # Newton steps of the ridged logistic fit
        p = 1 / (1 + np.exp(-(slope * z + offset)))
        w = p * (1 - p)
        hess = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(hess, np.array([((doc - p) * z).sum() - 1e-2 * slope, (doc - p).sum() - 1e-2 * offset]))
        slope, offset = slope + step[0], offset + step[1]
        if abs(step).max() < 1e-6:
            break
    return Model(mean, spread, weights, trans, float(slope), float(offset))


def score(model: Model | None, texts: list[str | None]) -> list[float]:
    if model is None or not texts:
        return [0.5] * len(texts)
    own, sizes, lengths, first, last = _chains(texts)
    x = with_neighbours((own - model.mean) / model.spread, first, last)
    good, _ = marginals(x @ model.weights, lengths, model.trans)
    return (1 / (1 + np.exp(-(model.slope * _mean(good, sizes, lengths, first) + model.offset)))).tolist()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 1000, max_chars: int = 20_000) -> Model | None:
    """``labels``: the rows to learn from.

    Of each label up to 4 x ``per_label`` ids are drawn by hash, and of these the first ``per_label`` whose texts have
    ``max_chars`` characters at most are learned from; where a label has none such, its first ``per_label`` / 20 texts.
    """
    ids = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("label IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    some = [ids.filter(F.col("label") == k).orderBy(*order).limit(4 * per_label) for k in (0, 1)]
    drawn = session.cut(some[0].union(some[1]))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sizes = texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n")).orderBy(*order).collect()
    chosen = []
    for k in (0, 1):
        short = [r.id for r in sizes if r.label == k and r.n <= max_chars][:per_label]
        chosen += short or [r.id for r in sizes if r.label == k][: max(1, per_label // 20)]
    if not chosen:
        return None
    wanted = drawn.filter(F.col("id").isin(chosen))
    got = texts.join(F.broadcast(wanted), "id").orderBy(*order, F.xxhash64("text")).limit(4 * per_label).collect()
    return fit([r.text for r in got], [r.label for r in got])


def judge(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(texts):
        made = score(sent.value, texts)
        return [made, [int(s >= threshold) for s in made]]

    return map_texts(docs, text_col, run, fields, docs.columns)
