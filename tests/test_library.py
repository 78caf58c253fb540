import pytest
from pyspark.sql import functions as F

from spanweave.functions import text as X
from spanweave.operators import chunkers as C
from spanweave.operators import datasets as D
from spanweave.operators import embed as E
from spanweave.operators import evaluate as V
from spanweave.operators import score as S
from spanweave.plans import tuner
from spanweave.plans.strategies import REGISTRY
from spanweave.schema import Config

PROSE = "First sentence here. Second one follows, longer than the first.\n\nA new paragraph. " * 20


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, content string")


@pytest.fixture(scope="module")
def corpus(spark):
    return docs(spark, PROSE, "日本語のテキストです。" * 30, "a", "", "x" * 5000, "Hello 🌍! " * 20, "# T\n## Page 1\nbody\n## Page 2\nmore").cache()


def test_every_text_strategy_keeps_its_offsets(spark, corpus):
    every = [Config(n, REGISTRY.get(n).grid[0]) for n in REGISTRY.names()]
    chunks = C.chunk(corpus, every).cache()
    assert C.violations(chunks, corpus).count() == 0
    assert {r[0] for r in chunks.select("config_id").distinct().collect()} == {c.id for c in every}
    assert chunks.where("doc_id = '3'").count() == 0
    assert chunks.where("lo >= hi").count() == 0


def test_windows_equal_slices_of_the_tokens(spark, corpus):
    import re

    some = {(m, o): Config("fixed_tokens", {"max_tokens": m, "overlap_tokens": o}) for m, o in ((4, 0), (5, 2), (1, 9))}
    got = {(r.config_id, r.doc_id, r.chunk_idx): (r.text, r.tokens, r.lo, r.hi) for r in C.by_kernel(corpus, list(some.values())).collect()}
    want = {}
    for r in corpus.collect():
        tokens = re.findall(r"[^ \t\n\r]+[ \t\n\r]*|[ \t\n\r]+", r.content)
        for (most, overlap), c in some.items():
            at = i = 0
            while tokens:
                hi = min(len(tokens), at + most)
                want[c.id, r.doc_id, i] = ("".join(tokens[at:hi]), hi - at, at, hi)
                if hi == len(tokens):
                    break
                at, i = at + most - min(overlap, most - 1), i + 1
    assert got == want


def test_partitioning_changes_nothing(spark, corpus):
    grid = [Config("fixed_tokens", {"max_tokens": 8, "overlap_tokens": 2}), Config("recursive_character", {"chunk_size_chars": 80})]
    one = tuner.recommend(corpus.coalesce(1), grid).collect()
    many = tuner.recommend(corpus.repartition(8), grid).collect()
    assert [(r.config_id, r.rank, round(r.score, 9)) for r in one] == [(r.config_id, r.rank, round(r.score, 9)) for r in many]


def test_normalisation_of_unicode_and_long_runs(spark):
    rows = spark.createDataFrame([("a\r\nb\rc \t\u00a0\n\n\n\n\n\nd" + " " * 20000 + "x  ",)], "t string")
    got = rows.select(X.normalize(F.col("t"))).first()[0]
    assert got == "a\nb\nc\n\n\nd" + " " * 20000 + "x"


def test_decoding_falls_back_to_latin1(spark):
    rows = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "b binary")
    assert [r[0] for r in rows.select(X.decoded(F.col("b"))).collect()] == ["é", "é"]


def test_jaccard_edges(spark):
    rows = spark.createDataFrame([("a b", " "), ("", "x"), ("a b c", "a b d"), ("a", "b")], "a string, b string")
    assert [r[0] for r in rows.select(X.token_jaccard_ok(F.col("a"), F.col("b"), 0.5)).collect()] == [True, False, True, False]


def test_unknown_documents_and_empty_gold_are_skipped(spark):
    d = docs(spark, "one two three four", "")
    q = D.trivial(d).unionByName(D.trivial(docs(spark, "z").select(F.lit("99").alias("doc_id"), "content")))
    assert [r.doc_id for r in V.queries_without_document(q, d).collect()] == ["99"]
    assert [r.doc_id for r in V.gold_ranges(q, d).collect()] == ["0"]


def test_gold_ranges_of_overlapping_spans_are_disjoint(spark):
    d = docs(spark, "aa bb cc dd ee ff")
    q = spark.createDataFrame([("q", "0", "?", [(0, 7), (4, 10), (15, 17), (2, 2)], None)], "query_id string, doc_id string, question string, answer_spans array<struct<a:int,b:int>>, reference_answer string")
    row = V.gold_ranges(q, d).first()
    assert sorted(i for g in row.gold for i in range(g.lo, g.hi)) == [0, 1, 2, 3, 5] and row.gold_size == 5


def test_weights(spark):
    with pytest.raises(ValueError):
        S.weights_for("rag_qa", {"mrr": -1.0})
    assert S.weights_for("nonsense") == S.PROFILES["rag_qa"] and S.weights_for("search", {}) == S.PROFILES["search"]
    up, down = ({"token_recall": r, "mrr": 0.5, "token_iou": 0.1, "duplication_ratio": d} for r, d in ((0.5, 0.2), (0.6, 0.1)))
    rows = spark.createDataFrame([(k, *m.values()) for k, m in (("a", up), ("b", down))], "config_id string, token_recall double, mrr double, token_iou double, duplication_ratio double")
    scores = {r.config_id: r.score for r in S.by_profile(rows).where("use_case = 'rag_qa'").collect()}
    assert scores["b"] > scores["a"]


def test_registry_guards():
    with pytest.raises(KeyError):
        REGISTRY.configs("text", ["nope"])
    with pytest.raises(ValueError):
        REGISTRY.check(Config("fixed_tokens", {"max_chunk_chars": 3}))
    assert REGISTRY.configs("code")[0].strategy == "code_ast"
    assert len(REGISTRY.configs("text")) == 27 and REGISTRY.configs("text")[0].params == {"max_tokens": 512, "overlap_tokens": 0}


def test_cache_embeds_misses_once(spark, tmp_path):
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    path = str(tmp_path / "cache")
    first = E.embed_cached(texts, path, E.hash_embedder(0), "p").collect()
    assert len(first) == 2 and len(first[0].vec) == 256
    again = E.embed_cached(texts.union(spark.createDataFrame([("c",)], "text string")), path, E.hash_embedder(0), "p")
    assert again.count() == 3 and spark.read.parquet(path).count() == 3
    assert E.embed_cached(texts, path, E.hash_embedder(0), "other").count() == 2


def test_files_repo_and_queries(spark, tmp_path):
    from spanweave.sources.readers import read_files, read_queries, read_repo

    (tmp_path / "in" / "node_modules").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# Hi\r\n\r\nthere  \n")
    (tmp_path / "in" / "b.txt").write_bytes(b"caf\xe9")
    (tmp_path / "in" / "c.bin").write_bytes(b"\0")
    (tmp_path / "in" / "d.py").write_text("x = 1  \n")
    (tmp_path / "in" / "e.min.js").write_text("x")
    (tmp_path / "in" / "node_modules" / "f.js").write_text("x")
    rows = read_files(spark, str(tmp_path / "in"), root=str(tmp_path)).collect()
    got = {r.path.rsplit("/", 1)[-1]: r for r in rows}
    assert set(got) == {"a.md", "b.txt", "d.py", "e.min.js", "f.js"}
    assert got["a.md"].content == "# Hi\n\nthere" and got["b.txt"].content == "café" and got["b.txt"].metadata["source_encoding"] == "latin-1"
    repo = {r.metadata["rel_path"]: r for r in read_repo(spark, str(tmp_path / "in")).collect()}
    assert set(repo) == {"a.md", "b.txt", "d.py"} and repo["d.py"].content == "x = 1  \n" and repo["d.py"].language == "python"
    with pytest.raises(PermissionError):
        read_files(spark, "/etc", root=str(tmp_path))
    (tmp_path / "set.json").write_text('{"queries": [{"question": "q", "document_id": "d", "answer_spans": [[0, 3]]}]}')
    row = read_queries(spark, str(tmp_path / "set.json")).first()
    assert row.dataset == "set" and row.answer_spans[0].b == 3 and len(row.query_id) == 64


def test_stream_chunks_files_as_they_come(spark, tmp_path):
    from spanweave.streaming.ingest import stream_chunks

    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    grid = [Config("fixed_tokens", {"max_tokens": 4, "overlap_tokens": 0})]
    frame = lambda i, t: spark.createDataFrame([(i, t)], "doc_id long, content string").write.mode("append").parquet(source)
    frame(1, "a b c d e")
    stream_chunks(spark, source, target, str(tmp_path / "c"), grid).awaitTermination()
    frame(2, "f g")
    stream_chunks(spark, source, target, str(tmp_path / "c"), grid).awaitTermination()
    assert spark.read.parquet(target).count() == 3


def test_preview_limit(spark):
    with pytest.raises(ValueError):
        tuner.preview(spark, "x" * 11, Config("fixed_tokens", {}), most=10)
    assert tuner.preview(spark, "word " * 100, Config("fixed_tokens", {"max_tokens": 50})).first().preview.endswith("...")


def test_large_query_sets_go_by_slices(spark):
    from spanweave.operators import datasets, embed

    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id < 25").selectExpr("vec_id AS query_id", "embedding AS query")
    want = sorted(map(tuple, embed.nearest_by_query(vectors, asked, 3).collect()))
    assert len(want) == 75 and sorted(map(tuple, embed.nearest_by_query(vectors, asked, 3, most=4).collect())) == want
    docs = spark.createDataFrame([(i, f"text {i} of word{i % 3}") for i in range(20)], "doc_id long, content string")
    phrases = spark.createDataFrame([(i, f"word{i % 4}") for i in range(9)], "item_id long, phrase string")
    want = sorted(map(tuple, datasets.phrase_hits(docs, phrases).collect()))
    assert want and sorted(map(tuple, datasets.phrase_hits(docs, phrases, most=2).collect())) == want
