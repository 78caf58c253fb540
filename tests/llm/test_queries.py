"""The registered queries on the smallest tables, against plain Python, libraries and their SQL."""

import base64
import glob
import html
import os
import re
import zlib

import duckdb
import pytest

from spanweave.llm import html_text, knn_quality, matroska
from spanweave.llm.registry import oracle_sql, queries

from . import brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def tables():
    found = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        found.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return found


@pytest.fixture(scope="module")
def documents(tables):
    return dict(tables.execute("select doc_id, text from documents").fetchall())


def collected(spark, name):
    return queries()[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_equal_their_sql(spark, tables, name):
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    cursor = tables.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert mine == sorted(tuple(str(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())


def test_op1(spark, documents):
    for r in collected(spark, "op1_quality_rules"):
        counts = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words
        assert counts == brute.quality_counts(documents[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_op2(spark, documents):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in collected(spark, "op2_packing"):
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(documents)
    for doc, rows in pieces.items():
        ids = [*model.encode(documents[doc] or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : at]))
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0


def test_op3(spark, documents):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = collected(spark, "op3_byte_bpe")
    assert len(rows) == len(documents)
    for r in rows:
        ids = own.encode_ordinary(documents[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(documents[r.doc_id] or ""))


def test_op4(spark, documents):
    for r in collected(spark, "op4_secret_scan"):
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute.base_secrets(documents[r.doc_id])


def test_op5(spark, documents):
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in collected(spark, "op5_line_dedup")}
    assert got == set(brute.line_dedup(documents))


def test_op6(spark, documents):
    prints = {d: brute.fingerprint(t) for d, t in documents.items()}
    near = brute.near(prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in collected(spark, "op6_simhash")} == {(d, f"{p:016x}", near[d]) for d, p in prints.items()}


def test_op7(spark, documents):
    features = {}
    for r in collected(spark, "op7_media"):
        raw = (documents[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = matroska.write(payload)
        assert brute.matroska_samples(media) == payload
        want = len(raw), len(payload), brute.sha(payload), zlib.crc32(payload[-64:]), len(media), brute.sha(media)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want
        assert features.setdefault(raw, r.feature) == r.feature


def test_op8(spark, tables):
    pages = {p: (u, h) for p, u, h in tables.execute("select page_id, url, html from pages").fetchall()}
    rows = collected(spark, "op8_html_text")
    assert len(rows) == len(pages)
    for r in rows:
        url, page = pages[r.page_id]
        inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
        blocks = re.split(rf"</?(?:{'|'.join(html_text.BLOCK)})\b[^>]*>", inner)
        words = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
        want = " ".join(w for w in words if w)
        assert (r.url, r.text, r.n_chars) == (url, want, len(want))


def test_op9(spark, documents):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = knn_quality.trained_on(docs, labels)
    rows = collected(spark, "op9_knn_quality")
    assert len(rows) == len(documents)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)
        assert abs(r.score - brute.vote(model, knn_quality.features(documents[r.doc_id] or "", model.fit.buckets))) < 1e-6


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_op9_is_right_on_held_out_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = queries()["op9_knn_quality"](spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_op10(spark, documents):
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in collected(spark, "op10_suffix_dedup")}
    assert got == set(brute.repeats(documents))
