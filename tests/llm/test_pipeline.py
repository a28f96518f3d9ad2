"""The pipeline's stages against plain Python, and the registered queries on a small fixture."""

import pytest

import corpus_pipeline
from tests.llm.test_dedup import brute_lines, groups_of, near_texts
from tests.llm.test_text import library
from tidemark.llm import language, pii, queries

COLUMNS = corpus_pipeline.COLUMNS


def fixture_rows():
    texts = near_texts(9, 120)
    shared = [f"{t}\nSubscribe now\nmail a{i}@b.co or +1 (988) 555-24{i % 90 + 10}" if i % 4 == 0 else t for i, t in enumerate(texts)]
    odd = [None, "", "123 456", shared[0], shared[0], "le chat " * 3000, "the cat"]
    rows = [(i, t, ("en", "fr")[i % 2] if t and i % 11 else None, f"src{i % 3}", len(t or "")) for i, t in enumerate(shared + odd)]
    return rows


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = fixture_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def by_id(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: (r[0], r[1] or ""))


def test_stages_against_brute_force(spark, table, tmp_path):
    folder, rows = table

    def stored(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert docs.columns == COLUMNS

    model = language.train(docs)
    names, scores = language.predict(model, [r[1] for r in rows])
    want = [r for r, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    kept = stored(corpus_pipeline.identify_language(spark, docs, folder), "a")
    assert by_id(kept) == want and {r[0] for r in rows} - {r[0] for r in want} >= {120, 121, 122}

    lines = ["\n".join(x) for x, _ in brute_lines([(r[0], r[1]) for r in want], 10)]
    want = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(want, lines, strict=True)]
    kept = stored(corpus_pipeline.drop_lines(spark, kept, folder), "b")
    assert by_id(kept) == want and not any("Subscribe" in r[1] for r in want)

    def parts(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [parts(r[1]) for r in want]
    alike = lambda a, b: a == b or len(a & b) >= corpus_pipeline.LEAST_JACCARD * len(a | b) - 1e-9
    links = [(a, b) for a in range(len(want)) for b in range(a) if alike(sets[a], sets[b])]
    want = [r for i, (r, g) in enumerate(zip(want, groups_of(len(want), links), strict=True)) if g == i]
    kept = stored(corpus_pipeline.drop_near_copies(spark, kept, folder), "c")
    assert by_id(kept) == want

    masked = [pii.mask(r[1], pii.find(r[1])) for r in want]
    want = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(want, masked, strict=True)]
    kept = stored(corpus_pipeline.mask_personal_data(spark, kept, folder), "d")
    assert by_id(kept) == want and not any("@b.co" in r[1] for r in want)

    tok = library("word_bpe_49k.json")
    total = {r[0]: len(tok.encode(r[1], add_special_tokens=False).ids) + 1 for r in want}
    for made in (corpus_pipeline.pack(spark, kept, folder).collect(), corpus_pipeline.run(spark, folder).collect()):
        sizes = {}
        for r in made:
            sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
        assert sizes == total


def test_stages_take_empty_tables(spark, table):
    folder, _ = table
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_queries_have_one_row_for_each_document(spark, table, tmp_path):
    folder, rows = table
    for name in ("op2_line_dedup", "op3_pii", "op4_bpe", "op6_simhash", "op7_exact_dedup", "op8_language"):
        got = queries.QUERIES[name](spark, folder)
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == [r[0] for r in rows], name
    prints = {r.doc_id: r.fingerprint for r in queries.op6_simhash(spark, folder).collect()}
    texts = {r[0]: r[1] for r in rows}
    from tests.llm.test_dedup import brute_fingerprint

    assert prints == {i: f"{brute_fingerprint(t):016x}" for i, t in texts.items()}
    import hashlib

    for r in queries.op3_pii(spark, folder).collect():
        base = [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and r.n_email == sum(s.startswith("email") for s in base)
