"""The registered queries on small tables: folds, leaks, links and whole rows, against brute force."""

import random
import zlib

import numpy as np
import pytest

from tests.llm.test_dedup import groups_of
from tidemark.llm import language, quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def documents(seed=3):
    rng = random.Random(seed)
    stems = {"en": "the and ing er tion th sh".split(), "fr": "le la ment eux oi eau que".split(), "el": "και το της στο αν ου ης".split(), "ru": "ов ст пр ние ал ра ко".split()}
    rows = []
    for i in range(160):
        lang = sorted(stems)[i % 4]
        good = i % 3 > 0
        lines = [" ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(9)).capitalize() + "." if good else "#$% 12 >> BUY " * rng.randrange(1, 4) for _ in range(5)]
        rows.append((i, "\n".join(lines), lang, "s", 0, int(good)))
    return rows


def write(spark, folder, rows, relabel=None):
    docs = [(i, t, relabel(i, lang) if relabel else lang, s, n) for i, t, lang, s, n, _ in rows] + [(900, None, None, "s", 0), (901, "", "en", "s", 0)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1 - q if relabel and fold(i, 5) == 0 else q, 0) for i, *_, q in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_held_out_rows_are_those_of_the_fold_and_teach_nothing(spark, tmp_path):
    rows = documents()
    write(spark, f"{tmp_path}/a", rows)
    # other labels on held-out rows, and others still on those of no fold that count: nothing may change
    write(spark, f"{tmp_path}/b", rows, lambda i, lang: "xx" if fold(i, 4) == 2 else lang)
    for name, n, rest in (("op8_language", 4, 2), ("op9_quality", 5, 0)):
        a, b = ({r.doc_id: r for r in queries.QUERIES[name](spark, f"{tmp_path}/{x}").collect()} for x in "ab")
        assert len(a) == len(rows) + 2 and a.keys() == b.keys()
        # sums of a batch differ in their last bits by what else is in it
        assert all(r[:1] + r[1:2] == b[i][:1] + b[i][1:2] and r.score == pytest.approx(b[i].score, abs=1e-6) for i, r in a.items())
        assert all((r.lang_pred if name == "op8_language" else r.predicted) == (b[i].lang_pred if name == "op8_language" else b[i].predicted) for i, r in a.items())
        assert all(r.held_out == (fold(i, n) == rest) for i, r in a.items())
    a = {r.doc_id: r for r in queries.op8_language(spark, f"{tmp_path}/a").collect()}
    assert all(a[i].lang_pred == lang for i, _, lang, *_, good in rows if good) and a[900].lang_pred == a[901].lang_pred == "und"  # four scripts and more
    q = {r.doc_id: r for r in queries.op9_quality(spark, f"{tmp_path}/a").collect()}
    assert all(q[i].predicted == label for i, *_, label in rows)


def test_scores_against_ridge_regression_in_full():
    """With every text a landmark, Nyström features lose nothing: scores are those of kernel ridge regression itself."""
    rows = documents(5)[:48]
    texts, labels = [r[1] for r in rows], [r[2] for r in rows]
    model = language.fit(texts, labels, landmarks=len(texts))
    sets = [set(language.grams(t).tolist()) for t in texts]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(kernel)
    x = np.hstack([vectors * np.sqrt(np.maximum(values, 0)), np.ones((len(texts), 1))])
    names = sorted(set(labels))
    goal = np.array([[1.0 if y == name else -1.0 for name in names] for y in labels])
    w = np.array([len(texts) / len(names) / labels.count(y) for y in labels])[:, None]
    ridge = np.diag([language.RIDGE * len(texts)] * (x.shape[1] - 1) + [1e-9])
    raw = x @ np.linalg.solve(x.T @ (w * x) + ridge, x.T @ (w * goal))
    got = language.kernels(model, [language.grams(t) for t in texts]) @ model.weights[:-1] + model.weights[-1]
    assert np.allclose(got, raw, atol=1e-3)


def test_training_climbs_the_likelihood_of_the_lines():
    """The slope that training follows is that of the penalised log-likelihood, by finite differences over all labellings."""
    from itertools import product

    rng = np.random.default_rng(2)
    lengths = np.array([3, 2])
    x, y = rng.normal(size=(5, 4)), np.array([1, 0, 1, 0, 0.0])
    first = np.array([0, 3])
    weights, trans = quality._climb(x, y, lengths, first, np.ones(5), steps=1500)

    def loss(v):
        u, t = x @ v[:4], v[4:].reshape(2, 2)
        total = 0.0
        for at, n in zip(first, lengths):
            scores = {lab: sum(u[at + i] * lab[i] for i in range(n)) + sum(t[lab[i - 1], lab[i]] for i in range(1, n)) for lab in product((0, 1), repeat=int(n))}
            total += scores[tuple(int(k) for k in y[at : at + n])] - np.log(sum(np.exp(list(scores.values()))))
        # lines and transitions weigh alike only up to their penalties: each part is taken at its own scale
        return total

    v = np.concatenate([weights, trans.ravel()])
    slope = np.array([(loss(v + 1e-5 * e) - loss(v - 1e-5 * e)) / 2e-5 for e in np.eye(8)])
    assert np.allclose(slope[:4] / 5, 1e-3 * weights, atol=5e-3) and np.allclose(slope[4:] / 3, 1e-2 * trans.ravel(), atol=5e-3)


def test_vectors_with_links_as_a_query(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 8))[rng.integers(0, 40, 200)] + rng.normal(size=(200, 8)) * 0.15
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + [(200, None, 0)], "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    full = x.astype(np.float32).astype(np.float64)
    size = np.sqrt((full**2).sum(axis=1))
    near = (full @ full.T) / np.outer(size, size) >= 0.95
    np.fill_diagonal(near, False)
    assert 100 < near.sum() < 5000
    want = groups_of(200, list(zip(*np.nonzero(near), strict=True)))
    got = {r.vec_id: r for r in queries.op10_embedding_dedup(spark, str(tmp_path)).collect()}
    assert {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in range(200)} == {i: (int(near[i].sum()), want[i], want[i] == i) for i in range(200)}
    assert (got[200].n_links, got[200].component_id) == (0, 200)


def test_packing_and_captures_as_queries(spark, tmp_path):
    rows = documents(6)
    write(spark, tmp_path, [*rows, (500, "word " * 9000, "en", "s", 0, 1)])
    made = queries.op5_packing(spark, str(tmp_path)).collect()
    bins = {}
    for r in made:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in bins.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(r.length for r in made) // 4096)
    assert {r.doc_id for r in made} == {r[0] for r in rows} | {500, 900, 901}
    spark.createDataFrame([(i, f"http://www.a.com/{i % 3}?utm_source=x", "<html>" + "x" * i) for i in range(9)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.record_id: r for r in queries.op1_warc_revisits(spark, str(tmp_path)).collect()}
    assert len(got) == 27 and all(got[f"a{i}"].status == "full" for i in range(9))
    # a day later the last full response of an address is that of its last page
    assert all(got[f"b{i}"].status == ("resolved" if i >= 6 else "mismatch") and got[f"b{i}"].matched_id == (f"a{i}" if i >= 6 else None) for i in range(9))


@pytest.mark.parametrize("gone", ["shard", "cut"])
def test_a_lost_shard_is_an_error(spark, tmp_path, gone):
    from tidemark.llm import line_dedup

    docs = spark.createDataFrame([(i, f"same\nline {i}") for i in range(20)], "doc_id long, text string")
    counts = line_dedup.count_lines(docs, "text", 1)
    folder = f"{tmp_path}/shards"
    assert line_dedup.build_index(counts, folder) == 1
    assert line_dedup.probe(["same\nx"], folder, 1, 10, 1) == [["x"], [2], [1]]
    line_dedup._shards.clear()
    path = tmp_path / "shards" / "shard-0"
    if gone == "shard":
        path.unlink()
    else:
        path.write_bytes(path.read_bytes()[:-8])
    with pytest.raises((FileNotFoundError, ValueError)):
        line_dedup.probe(["same"], folder, 1, 10, 1)
