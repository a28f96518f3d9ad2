"""Personal data, BPE, packing, language, quality and captures against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import bpe, language, packing, pii, quality, warc
from tidemark.llm.queries import vocabulary

DOCS = "doc_id long, text string, score string, spans string, length string, ids string"
ODD = [
    None, "", " ", "a", "  a  b \n\n c", "don't I'LL we've", "x" * 3000, "ab " * 2000, "é" * 500, " a b", "a\x1cb \x85c", "日本語 text 123 ½ ²", "<|endoftext|>a<|endoftext|>",
    "<|ENDOFTEXT|> <|startoftext|>b", "é ́x", "İstanbul ß ſ", "\U0001f600 \U0001f468‍\U0001f469", "a\tb\x0bc\x0cd\re", "tab\t\tx", " lead", "trail ", "12345 6789", "!!! ??? ...", "a" * 100 + "1" * 100,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", "p", "l", "i") for i, t in enumerate(texts)], DOCS)


# Personal data.


def brute_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


PII = [
    None, "", "no data", "a@b.c@d.e x.y@@z.w @a.b q@w", "mail é.jo@x-1.example.com. and 1.2.3.4.5.6.7.8", "300.1.1.1 0255.001.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111",
    "+1 (988) 555-2485 or +49-30-123456 ++1 23 +1234567890123456", "12.34.56.78 @x a@b..c a@b.c.", "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433", "password = \"abcdef0123456789\"", "4111111111111111@x.yz 1.1.1.1@1.1",
    "1" * 5000, "a" * 5000, "a@" * 2000, "+1" * 2000, "1." * 2000, "x" * 50 + "😀a@b.co",
]


def test_pii_base_spans(spark):
    rows = pii.pii_spans(frame(spark, PII), masked=True).collect()
    for r in rows:
        text = PII[r.doc_id]
        base = [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in pii.BASE]
        assert base == brute_base(text or ""), text
        assert all(0 <= s.score <= 1 for s in r.spans)
        assert (r.text is None) == (text is None)
        if text and not r.spans:
            assert r.text == text
    kinds = {i: {s.kind for s in r.spans} for r in rows for i in [r.doc_id]}
    assert "iban" in kinds[9] and kinds[10] == {"secret"}
    assert pii.pii_spans(frame(spark, [])).count() == 0


def test_random_strings_have_the_same_base_spans():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        text = "".join(rng.choice(list("a1@.-+( 2"), 60))
        got = [f"{k}:{a}:{b}" for a, b, k, _ in pii.find(text) if k in pii.BASE]
        assert got == brute_base(text), text


def test_masking_and_checksums():
    text = "call +1 (988) 555-2485 or a@b.co"
    assert pii.mask(text, pii.find(text)) == "call <PHONE> or <EMAIL>"
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    near, far = pii.find("my card 4111111111111111")[0][3], pii.find("order 4111111111111111")[0][3]
    assert near > far


# BPE.


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def test_bpe_is_the_library_s(spark):
    texts = ODD + [" ".join(ODD[3:12])] * 3
    tok = library("byte_bpe_50k.json")
    for r in bpe.bpe_encode(frame(spark, texts), vocabulary("byte_bpe_50k.json"), lexicon_words=20).collect():
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids, texts[r.doc_id]
        assert r.n_tokens == len(ids) and r.decoded == tok.decode(ids, skip_special_tokens=False) and r.score == "s"
    assert bpe.bpe_encode(frame(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


def test_words_are_the_library_s_for_all_code_points():
    tok, coder = library("byte_bpe_50k.json"), bpe.Encoder(bpe.Vocabulary(vocabulary("byte_bpe_50k.json")), None)
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xE0000, 0xE01F0)]
    texts = [f"a{c}b {c}1{c}{c} {c}" for c in points]
    for i in range(0, len(texts), 5000):
        some = texts[i : i + 5000]
        for t, e in zip(some, tok.encode_batch(some, add_special_tokens=False), strict=True):
            assert np.frombuffer(coder.encode(t), "<u4").tolist() == e.ids, ascii(t)


def test_lexicon_is_minimal_and_complete():
    vocab = bpe.Vocabulary(vocabulary("byte_bpe_50k.json"))
    words = sorted({w.encode() for w in ["walking", "talking", "walked", "talked", "walk", "", " talk", "é"]})
    lex = bpe.Lexicon(bpe.compile_lexicon(words, [vocab.merge(w) for w in words]))
    assert all(lex.get(w) == vocab.merge(w) for w in words)
    assert lex.get(b"wal") is None and lex.get(b"walkingx") is None and lex.get(b"\xff") is None
    assert len(lex.final) < sum(map(len, words))
    empty = bpe.Lexicon(bpe.compile_lexicon([], []))
    assert empty.get(b"a") is None


def test_long_words_merge_alike():
    vocab = bpe.Vocabulary(vocabulary("byte_bpe_50k.json"))
    tok = library("byte_bpe_50k.json")
    rng = np.random.default_rng(2)
    for n in (30, 47, 49, 500):
        word = "".join(rng.choice(list("etaoinshr"), n))
        assert vocab.merge(word.encode()) == tok.encode(word, add_special_tokens=False).ids


# Packing.


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_PIECES", 300)
    rng = np.random.default_rng(3)
    texts = ODD + ["word " * 9000] + [" ".join(["ab"] * int(n)) for n in rng.integers(1, 3000, 900)]
    tok = library("word_bpe_49k.json")
    rows = packing.pack_documents(frame(spark, texts), vocabulary("word_bpe_49k.json")).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    seen, bins = {}, {}
    for r in rows:
        cut = ids[r.doc_id][r.start : r.start + r.length]
        assert len(cut) == r.length == min(4096, len(ids[r.doc_id]) - 4096 * r.piece) and r.start == 4096 * r.piece
        assert r.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
        seen.setdefault(r.doc_id, set()).add(r.piece)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: set(range(-(-len(x) // 4096))) for i, x in ids.items()}
    for some in bins.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(map(len, ids.values())) // 4096)
    assert len(bins) <= least * 1.01 + 2
    assert packing.pack_documents(frame(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


def test_chunks_are_the_library_s():
    tok, coder = library("word_bpe_49k.json"), packing.ChunkTokenizer(vocabulary("word_bpe_49k.json"))
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}1{c}{c} {c} X{c.upper()}'S" for c in points] + [f"{a}{b} {b}É{a}" for a in map(chr, range(256)) for b in "aÉ1'%\u0301 "] + ODD[1:]
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == e.ids, ascii(t)


@pytest.mark.parametrize("seed", range(20))
def test_local_search_keeps_pieces_and_never_adds_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 120) if seed % 2 else rng.integers(26, 60, 120)
    bins = packing.best_fit(lengths, 100)
    better = packing.improve([list(b) for b in bins], lengths, 100)
    assert sorted(i for b in better for i in b) == list(range(120))
    assert max(sum(lengths[i] for i in b) for b in better) <= 100
    assert len(better) <= len(bins)


# Language and quality.


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.filter("doc_id % 4 <> 2"))
    got = language.identify(docs.select("doc_id", "text", "lang"), model).collect()
    right = [r.lang == r.lang_pred for r in got if r.doc_id % 4 == 2]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_texts(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", "x"), (2, "le chat", "fr", "y"), (3, None, None, "z"), (4, "x", None, "z")], "doc_id long, text string, lang string, score string")
    model = language.train(docs)
    texts = [None, "", "123 !?", "the", "le " * 20_000, "日本"]
    names, scores = language.predict(model, texts)
    assert names[:3] == ["und"] * 3 and names[3] == "en" and names[4] == "fr" and scores[:3] == [0.0] * 3
    assert {r.lang_pred for r in language.identify(docs, model).collect()} <= {"en", "fr", "und"}
    assert language.train(docs.limit(0)) is None
    assert [r.lang_pred for r in language.identify(docs, None).collect()] == ["und"] * 4


def test_kernel_is_the_normalised_number_of_shared_grams():
    a, b = language.grams("abc"), language.grams("abd")
    assert len(a) == 6 and len(np.intersect1d(a, b)) == 3
    model = language.fit(["abc", "xyz"], ["l", "m"])
    assert np.allclose(language.kernels(model, [b])[0, 0], 3 / 6)
    # the columns are those of the rule, for any script
    text = "Жук 1 日"
    s = [c if (c := language.symbols(x)[0]) < 3 else ord(x.lower()) + 3 for x in text]
    want = set()
    for n in range(3):
        for i in range(len(s) - n):
            total = sum(int(s[i + k]) * int(language.PLACES[k]) for k in range(n + 1)) & 0xFFFFFFFF
            want.add((total * int(language.KINDS[n]) + int(language.KINDS[n]) & 0xFFFFFFFF) >> 14)
    assert sorted(want) == language.grams(text).tolist()


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(4)
    lengths = np.array([1, 4, 3, 4])
    unary, trans = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    good, pairs = quality.marginals(unary, lengths, trans)
    at, total = 0, np.zeros((2, 2))
    for n in lengths:
        u, mass, ones = unary[at : at + n], 0.0, np.zeros(n)
        two = np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            p = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n)))
            mass += p
            ones += p * np.array(y)
            for i in range(1, n):
                two[y[i - 1], y[i]] += p
        assert np.allclose(good[at : at + n], ones / mass)
        total += two / mass
        at += n
    assert np.allclose(pairs, total)


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels.filter("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in quality.judge(docs.select("doc_id", "text"), model).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.filter("doc_id % 5 = 0").collect()]
    assert sum(q == g.predicted for q, g in held) / len(held) > 0.93
    odd = quality.score(model, [None, "", "\n" * 5000, "a" * 100_000])
    assert odd[0] == odd[1] and all(0 <= s <= 1 for s in odd)
    assert quality.train(docs, labels.limit(0)) is None
    assert quality.score(None, ["a"]) == [0.5]


# Captures.


def test_revisits_against_brute_force(spark):
    import datetime as dt
    import random

    rng = random.Random(5)
    rows = []
    for i in range(400):
        url = rng.choice(["http://a.com/x", "https://www.a.com/x/#f", "http://b.com/?utm_source=1", None] if i % 3 else ["http://a.com/x"])
        ts = None if rng.random() < 0.03 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(150))
        headers = {k: v for k, v in (("etag", rng.choice(['"1"', 'W/"1"', '"2"', None])), ("last-modified", rng.choice(["m1", "m2", None])), ("server", str(i)), ("expires", str(i))) if v}
        rows.append((f"r{i:03}", ts, url, rng.random() < 0.6, headers, rng.choice(["d1", None, None]), None))
    frame_ = spark.createDataFrame(rows, warc.CAPTURES).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = {r.record_id: r for r in warc.resolve_revisits(frame_).collect()}
    canon = {"http://a.com/x": "a.com/x", "https://www.a.com/x/#f": "a.com/x", "http://b.com/?utm_source=1": "b.com/", None: None}
    for rid, ts, url, revisit, headers, digest, _ in rows:
        r = got[rid]
        if not revisit:
            assert r.status == "full" and r.matched_id is None
            continue
        before = [x for x in rows if not x[3] and url and ts and x[1] and x[2] and canon[x[2]] == canon[url] and (x[1], x[0]) < (ts, rid)]
        if not before:
            assert r.status == "no_response"
            continue
        last = max(before, key=lambda x: (x[1], x[0]))
        strip = lambda h: h.get("etag", "").removeprefix("W/")
        if digest and last[5] and digest != last[5]:
            want = "mismatch"
        elif "etag" in headers and "etag" in last[4]:
            want = "resolved" if strip(headers) == strip(last[4]) else "mismatch"
        elif "last-modified" in headers and "last-modified" in last[4]:
            want = "resolved" if headers["last-modified"] == last[4]["last-modified"] else "mismatch"
        else:
            want = "resolved" if digest and last[5] else "unverified"
        assert r.status == want and r.matched_id == (last[0] if want in ("resolved", "unverified") else None)
        if want == "resolved":
            assert r.headers == last[4] | {k: v for k, v in headers.items() if k in warc.PERMITTED}
    assert warc.resolve_revisits(frame_.limit(0)).count() == 0


def test_warc_files_round_trip(spark, tmp_path):
    body = b"<html>\r\n\r\nWARC/1.0 \xff</html>"
    rows = [
        {"record_id": "urn:1", "ts": "2024-01-01T00:00:00Z", "url": "http://a.com/", "revisit": False, "headers": {"etag": '"1"', "server": "s"}, "digest": warc.payload_digest(body), "body": body},
        {"record_id": "urn:2", "ts": "2024-01-02T00:00:00Z", "url": "http://www.a.com", "revisit": True, "headers": {"etag": '"1"', "expires": "0"}, "digest": None, "body": None},
    ]
    data = warc.write_warc(rows)
    assert list(warc.parse_warc(data)) == rows
    (tmp_path / "a.warc").write_bytes(data)
    captures = warc.read_warc(spark, str(tmp_path))
    done = {r.record_id: r for r in warc.with_bodies(warc.resolve_revisits(captures), captures).collect()}
    assert done["urn:2"].status == "resolved" and bytes(done["urn:2"].body) == body
    assert done["urn:2"].headers == {"etag": '"1"', "server": "s", "expires": "0"}


def test_damaged_warc_files_become_rows_with_an_error(spark, tmp_path):
    import gzip

    rows = [{"record_id": f"urn:{i}", "ts": "2024-01-01T00:00:00Z" if i else "yesterday", "url": "http://a.com/", "revisit": False, "headers": {}, "digest": None, "body": b"x" * 2000} for i in range(3)]
    data = warc.write_warc(rows)
    (tmp_path / "whole.warc").write_bytes(data)
    (tmp_path / "cut.warc").write_bytes(data[:-1000])
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(data)[:-12])
    (tmp_path / "junk.warc").write_bytes(b"no record")
    (tmp_path / "length.warc").write_bytes(data.replace(b"Content-Length: 2", b"Content-Length: z", 1))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sum(r.error is None for r in got) >= 5 and sum(r.error is not None for r in got) == 4
    assert all(r.record_id is None and r.revisit is None for r in got if r.error)
    assert {r.ts is None for r in got if r.record_id == "urn:0"} == {True}
    assert warc.resolve_revisits(warc.read_warc(spark, str(tmp_path))).count() == len(got)


def test_repeated_records_and_clashing_columns(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [("r", t, "http://a.com", False, {"etag": "1"}, None, b"b", "x"), ("r", t, "http://a.com", False, {"etag": "1"}, None, b"a", "x"), ("v", t + dt.timedelta(1), "http://a.com", True, None, None, None, "x"), ("w", t + dt.timedelta(2), "http://a.com", None, None, None, b"n", "x")]
    captures = spark.createDataFrame(rows, warc.CAPTURES + ", task string")
    done = warc.with_bodies(warc.resolve_revisits(captures), captures).collect()
    assert sorted((r.record_id, r.status, r.matched_id, bytes(r.body) if r.body else None) for r in done) == [("r", "full", None, b"a"), ("r", "full", None, b"a"), ("v", "unverified", "r", None), ("w", "full", None, b"n")]


def test_shared_files_are_whole(tmp_path):
    from tidemark.llm.common import map_file, write_file

    write_file(f"file://{tmp_path}/d/x", b"abc")
    assert map_file(f"file://{tmp_path}/d/x")[:] == b"abc"
    assert hashlib.sha256(map_file(f"{tmp_path}/d/x")[:]).hexdigest() == hashlib.sha256(b"abc").hexdigest()
