"""Strategies of the caller's own, guards, failures, converters, caches, settings and commands."""

import json

import pytest
from pyspark.sql import functions as F

from spanweave import __main__ as command
from spanweave.operators import chunkers as C
from spanweave.operators import datasets as D
from spanweave.operators import embed as E
from spanweave.operators import evaluate as V
from spanweave.operators import kernels as K
from spanweave.plans import strategies as S
from spanweave.plans import tuner
from spanweave.plans.catalogue import QUERIES
from spanweave.schema import Config
from spanweave.sources import readers as R
from spanweave.sources import workspace as W

TEXTS = ["One two three. Four five six.\n\nSeven eight nine ten. " * 6, "alpha beta gamma delta " * 40, "short", ""]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, content string").cache()


class Halves:
    """Two halves of a text."""

    name, types, params, grid = "halves", ("text",), ("at",), ({"at": 0.5},)

    def chunk(self, text, params, ends):
        cut = int(len(text) * params.get("at", 0.5))
        if params.get("at") == 2:
            raise ArithmeticError("no such place")
        if 0 < cut:
            yield 0, cut
        yield cut, len(text)


@pytest.fixture
def halves():
    assert isinstance(Halves(), S.Chunking)
    S.REGISTRY.register(Halves())
    yield S.REGISTRY
    del S.REGISTRY._held["halves"]


def test_own_strategies_run_in_grids(spark, docs, halves):
    got = tuner.chunked(docs, [Config("halves", {"at": 0.25}), Config("fixed_tokens", {"max_tokens": 8})])
    own = [(r.doc_id, r.start_offset, r.end_offset) for r in got.where("config_id LIKE 'halves%'").orderBy("doc_id", "chunk_idx").collect()]
    assert own == [(i, a, b) for i, t in enumerate(TEXTS[:3]) for a, b in ((0, len(t) // 4), (len(t) // 4, len(t)))]
    assert C.violations(got, docs).count() == 0
    ranking = tuner.recommend(docs, [Config("fixed_tokens", {"max_tokens": 8}), Config("halves", {"at": 0.5})]).collect()
    assert {r.rank for r in ranking} == {1, 2} and all(r.error is None for r in ranking)
    with pytest.raises(TypeError):
        halves.register(S.Strategy("empty", ("text",), ()))
    with pytest.raises(KeyError):
        C.chunk(docs, [Config("nothing", {})])


def test_a_failing_configuration_has_an_error_and_the_others_a_rank(spark, docs, halves):
    good, bad = Config("fixed_tokens", {"max_tokens": 8}), Config("halves", {"at": 2})
    ranking = {r.config_id: r for r in tuner.recommend(docs, [good, bad]).collect()}
    assert ranking[good.id].rank == 1 and ranking[good.id].error is None and ranking[good.id].scoring_ms > 0
    assert ranking[bad.id].rank is None and "no such place" in ranking[bad.id].error
    with pytest.raises(RuntimeError, match="no such place"):
        tuner.recommend(docs, [bad])
    rows = C.chunk(docs, [good, bad], own=S.REGISTRY.kernels(), errors=True)
    assert rows.where("error IS NOT NULL").count() == 3 and rows.where("error IS NULL").count() > 3
    with pytest.raises(Exception, match="no such place"):
        C.chunk(docs, [bad], own=S.REGISTRY.kernels()).count()


def test_types_are_guarded(spark, docs):
    typed = docs.withColumn("content_type", F.lit("text"))
    assert tuner.chunked(typed, [Config("fixed_tokens", {})]).count() == 3
    for name in ("code_window", "pdf_structural", "markdown_semantic"):
        with pytest.raises(Exception, match="not all of"):
            tuner.chunked(typed, [Config(name, {})]).count()
        with pytest.raises(Exception, match="not all of"):
            tuner.recommend(typed, [Config(name, {})]).count()


def test_recorded_spans_stand_for_agentic_ones(spark, docs):
    spans = spark.createDataFrame([(0, 0, 0, 20), (0, 1, 10, 40)], "doc_id long, i int, start_offset int, end_offset int")
    agentic, fixed = Config("agentic", {"max_propositions": 30}), Config("fixed_tokens", {"max_tokens": 8})
    got = C.chunk(docs, [agentic, fixed], recorded=spans)
    mine = got.where(F.col("config_id") == agentic.id).orderBy("doc_id", "chunk_idx").collect()
    assert [(r.doc_id, r.start_offset, r.end_offset) for r in mine] == [(0, 0, 20), (0, 10, 40), (1, 0, len(TEXTS[1])), (2, 0, 5)]
    assert {r.rank for r in tuner.recommend(docs, [fixed, agentic], recorded=spans).collect()} == {1, 2}


def test_scores_of_the_grid_equal_those_of_given_chunks(spark, docs):
    grid = [Config("fixed_tokens", {"max_tokens": m}) for m in (4, 9)] + [Config("recursive_character", {"chunk_size_chars": 60})]
    queries = D.trivial(docs).union(D.anchored(docs, [("a", "five six", "Five?"), ("b", "gamma", "Gamma?")]))
    gold = V.gold_ranges(queries, docs)
    columns = ["config_id", "query_id", "chunk_idx", "lo", "hi", "tokens", "rank", "rel", "gold_size"]
    both = [
        V.rank_scored(V.score_grid(docs, queries, grid, E.hash_embedder(0)), gold),
        V.rank_chunks(C.chunk(docs, grid), queries, gold, E.hash_embedder(0)),
    ]
    one, two = (sorted(map(tuple, b.select(*columns, F.round("sim", 8)).collect())) for b in both)
    assert one == two and len(one) > 50


def test_metrics_in_the_pass_equal_those_by_windows(spark, docs):
    grid = [Config("fixed_tokens", {"max_tokens": m, "overlap_tokens": o}) for m, o in ((3, 2), (9, 0))] + [Config("recursive_character", {"chunk_size_chars": 60, "chunk_overlap_chars": 30})]
    spans = "array(struct(3 AS a, 40 AS b), struct(90 AS a, 120 AS b), struct(30 AS a, 44 AS b))"
    queries = D.trivial(docs).union(docs.selectExpr("concat('m_', doc_id) AS query_id", "doc_id", "'Many?' AS question", f"{spans} AS answer_spans", "CAST(NULL AS string) AS reference_answer"))
    scored = V.score_grid(docs, queries, grid, E.hash_embedder(0))
    stats = V.with_effective_k(V.chunk_stats(scored.where("head")), 40)
    fits = {r.config_id: r.effective_k for r in stats.collect()}
    want = V.per_query(V.rank_scored(scored, V.gold_ranges(queries, docs)), stats)
    got = V.grid_metrics(docs, queries, grid, fits, E.hash_embedder(0))
    columns = [*V.KEY, *V.METRICS, "tokens_in_context"]
    plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(columns).collect())
    assert plain(got) == plain(want) and len(plain(got)) == 3 * 6
    same = ["config_id", "n_chunks", "chunk_tokens", "avg_chunk_length", "chunk_length_std"]
    one, two = (sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in s.select(same).collect()) for s in (stats, V.grid_stats(docs, grid)))
    assert one == two


@pytest.fixture(scope="module")
def asked(docs):
    """A small grid, its chunks in context, and several questions a document, of which some touch no token."""
    grid = [Config("fixed_tokens", {"max_tokens": m, "overlap_tokens": o}) for m, o in ((3, 2), (9, 0), (500, 0))]
    spans = "array(struct(3 AS a, 40 AS b))"
    queries = D.trivial(docs).union(docs.selectExpr("concat('m_', doc_id) AS query_id", "doc_id", "'Many?' AS question", f"{spans} AS answer_spans", "'ref' AS reference_answer"))
    queries = queries.union(docs.selectExpr("concat('n_', doc_id)", "doc_id", "'None?'", "array(struct(0 AS a, 0 AS b))", "'ref'"))
    stats = V.with_effective_k(V.chunk_stats(C.chunk(docs, grid)), 40)
    return grid, queries, stats, {r.config_id: r.effective_k for r in stats.collect()}


def _moved(df):
    """The columns that the exchanges of a plan that hasn't run yet move."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        if node.nodeName() == "Exchange":
            found += [node.output().apply(i).name() for i in range(node.output().size())]
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_contexts_in_the_pass_equal_those_by_joins(spark, docs, asked):
    grid, queries, stats, fits = asked
    # Questions of one document whose chunks are many alike, so that ties are settled by place.
    docs = docs.union(spark.createDataFrame([(9, "same words here " * 30 + "end")], docs.schema))
    queries = queries.union(D.trivial(docs.where("doc_id = 9")))
    ranked = V.rank_scored(V.score_grid(docs, queries, grid, E.hash_embedder(0)), V.gold_ranges(queries, docs))
    want = V.contexts(ranked, stats, C.chunk(docs, grid))
    got = V.grid_contexts(docs, queries, grid, fits, E.hash_embedder(0))
    moved = _moved(got)
    assert moved.count("content") == 1 and not {"text", "context"} & set(moved)
    plain = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert got.columns == want.columns and plain(got) == plain(want) and len(plain(got)) == 3 * 7


def test_contexts_of_recorded_spans(spark, docs):
    spans = spark.createDataFrame([(0, 1, 20, 40), (0, 0, 0, 20)], "doc_id long, i int, start_offset int, end_offset int")
    agentic = Config("agentic", {"max_propositions": 30})
    got = V.grid_contexts(docs, D.trivial(docs), [agentic], {agentic.id: 5}, E.hash_embedder(0), recorded=spans)
    found = {r.query_id: r.context for r in got.collect()}
    assert set(found) == {"q_0", "q_1", "q_2"} and found["q_2"] == "short"
    assert found["q_0"] in (f"{TEXTS[0][:20]}\n\n{TEXTS[0][20:40]}", f"{TEXTS[0][20:40]}\n\n{TEXTS[0][:20]}")


def test_answers_meet_contexts_in_one_pass_as_by_joins(spark, docs, asked):
    grid, queries, stats, fits = asked
    ids = "array(" + ", ".join(f"'{c.id}'" for c in grid[1:]) + ", 'none', NULL)"
    answers = queries.where("doc_id <> 1").selectExpr(f"explode({ids}) AS config_id", "query_id", "concat('to ', query_id) AS answer")
    # A second answer to one question, and one to a question that there isn't.
    answers = answers.union(answers.where("query_id = 'q_0'").selectExpr("config_id", "query_id", "CAST(NULL AS string)")).union(answers.selectExpr("config_id", "'gone'", "answer").limit(1))
    ranked = V.rank_scored(V.score_grid(docs, queries, grid, E.hash_embedder(0)), V.gold_ranges(queries, docs))
    want = V.answered(V.contexts(ranked, stats, C.chunk(docs, grid)), queries, answers)
    got = V.grid_answered(docs, queries, answers, grid, fits, E.hash_embedder(0))
    # Texts are moved once, and neither chunks nor contexts are.
    moved = _moved(got)
    assert moved.count("content") == 1 and not {"text", "context"} & set(moved)
    plain = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert got.columns == want.columns and plain(got) == plain(want) and len(plain(got)) == 2 * 4 + 2


@pytest.mark.parametrize("name", ["answers_to_judge", "answer_contexts"])
def test_queries_of_contexts_move_no_chunks(spark, docs, tmp_path, name):
    docs.selectExpr("doc_id", "content AS text").write.parquet(f"{tmp_path}/documents.parquet")
    moved = _moved(QUERIES[name](spark, str(tmp_path)))
    assert moved.count("content") <= 1 and not {"text", "context"} & set(moved)


def test_many_queries_of_one_document_go_in_parts(spark, docs, monkeypatch):
    grid = [Config("fixed_tokens", {"max_tokens": 9})]
    queries = docs.where("doc_id < 2").selectExpr("doc_id", "explode(sequence(0, 20)) AS i", "content")
    queries = queries.selectExpr("concat(doc_id, '_', i) AS query_id", "doc_id", "concat('Q', i) AS question", "array(struct(i AS a, i + 9 AS b)) AS answer_spans", "CAST(NULL AS string) AS reference_answer")
    whole = tuner.recommend(docs, grid, queries).drop("scoring_ms").collect()
    monkeypatch.setattr(V, "TOGETHER", 4)
    scored = V.score_grid(docs, queries, grid, E.hash_embedder(0))
    assert scored.count() > scored.where("head").count() == C.chunk(docs, grid).count()
    parts = tuner.recommend(docs, grid, queries).drop("scoring_ms").collect()
    assert [[round(x, 9) if isinstance(x, float) else x for x in r] for r in parts] == [[round(x, 9) if isinstance(x, float) else x for x in r] for r in whole]


@pytest.mark.parametrize(
    ("answer", "found"),
    [
        ('<think>{"a": 1}</think> {"b": 2} tail', '{"b": 2}'),
        ('```json\n[1, 2]\n``` {"x": 1}', "[1, 2]"),
        ("prose {not json} [3]", "[3]"),
        ("nothing", None),
        (None, None),
        ("{" * 300 + "[1]", "[1]"),
    ],
)
def test_first_json(answer, found):
    assert K.first_json(answer) == found


def test_proposed_spans_take_several_shapes():
    spans = lambda a: [(s["a"], s["b"], s["t"]) for s in json.loads(K.proposed_spans(a))]
    assert spans('{"chunks": [{"start": 1, "end_offset": "7", "content": "x"}]}') == [(1, 7, "x")]
    assert spans('{"chunks": {"chunks": [{"start": 1}]}}') == [(1, 0, "")]
    assert spans('[5, {"start": null}, {"start": 1e400}, {"end": 99999999999}]') == [(0, (1 << 31) - 1, "")]
    assert spans('{"chunks": 3}') == spans("7") == spans("") == []


def test_misaligned_tokens_snap_or_fail(spark):
    import public_tokenizers as P

    bpe = {"ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}
    ends = K.bpe_bounds("😀 ok", **bpe)
    assert ends[0] == 0 and ends[-1] == 4 and ends == sorted(ends)
    with pytest.raises(ValueError):
        K.bpe_bounds("ꙮ ok", **bpe, misaligned="error")
    assert K.bpe_bounds("plain ok", **bpe, misaligned="error") == K.bpe_bounds("plain ok", **bpe)
    assert len(K.bpe_ids("a <|endoftext|>", **bpe)) > 2


def test_provider_is_asked_in_batches_and_again(monkeypatch):
    import pandas as pd

    calls = []

    def call(texts):
        calls.append(len(texts))
        if len(calls) == 2:
            raise OSError("busy")
        return [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))]

    found = E.provider_embedder(call, most=3, wait=0)(pd.Series(["a", "bb", "ccc", "dddd"], index=[5, 6, 7, 8]))
    assert calls == [3, 1, 1] and [v[0] for v in found] == [1, 2, 3, 4] and list(found.index) == [5, 6, 7, 8]
    assert E.provider_embedder(call)(pd.Series([], dtype=object)).empty

    def never(texts):
        raise OSError("down")

    with pytest.raises(OSError):
        E.provider_embedder(never, tries=2, wait=0)(pd.Series(["a"]))
    assert E.embedder_for(None)[0] == E.embedder_for("m", dummy=True)[0] == "hash_v1"
    with pytest.raises(ValueError):
        E.embedder_for("m")
    assert E.embedder_for("m", call)[0] == "m"


def test_query_vectors_have_keys_of_their_own(spark, tmp_path):
    path, texts = str(tmp_path / "v"), spark.createDataFrame([("a",), ("b",)], "text string")
    one = E.embed_cached(texts, path, E.hash_embedder(0), "p").collect()
    two = E.embed_cached(texts, path, E.hash_embedder(1), "p", role="query").collect()
    assert E.opened(spark, path).count() == 4 and {r.text_hash for r in one}.isdisjoint(r.text_hash for r in two)
    assert E.cache_clear(spark, path) and not E.cache_clear(spark, path) and E.cache_stats(E.opened(spark, path)).first().entries == 0


def test_chunk_cache(spark, docs, tmp_path):
    path = str(tmp_path / "chunks")
    twice = docs.union(spark.createDataFrame([(9, TEXTS[1])], "doc_id long, content string"))
    grid = [Config("fixed_tokens", {"max_tokens": 8}), Config("recursive_character", {"chunk_size_chars": 60})]
    built = []

    def build(d, c):
        built.append(d.count())
        return C.chunk(d, c)

    want = sorted(map(tuple, C.chunk(twice, grid).select(*C.COLUMNS).collect()))
    first = sorted(map(tuple, E.chunk_cached(twice, grid, path, build).select(*C.COLUMNS).collect()))
    again = sorted(map(tuple, E.chunk_cached(twice, grid, path, build).select(*C.COLUMNS).collect()))
    assert first == again == want and built == [4, 4, 0, 0]
    stats = E.chunk_cache_stats(spark.read.parquet(path)).first()
    assert stats.entries == 8 and stats.approx_bytes > 0


def test_datasets_fall_back(spark, docs):
    none, some = [("x", "no such words", "?")], [("g", "gamma", "Gamma?")]
    assert D.anchored_or_trivial(docs, none).count() == 4 and D.anchored_or_trivial(docs, some).count() == 1
    assert D.chosen(None, docs) is docs and D.chosen(docs, docs.limit(1), least=4) is docs
    assert D.chosen(docs, none := docs.limit(1), least=5) is none
    rows = D.prompts(docs, 10).collect()
    assert [r.truncated for r in sorted(rows)] == [True, True, False, False] and all(len(r.prompt) <= 10 for r in rows)


def test_phrases_of_any_length_in_long_texts(spark):
    import random

    rng = random.Random(5)
    words = [f"wörd{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 3000))) for _ in range(12)]
    phrases = [texts[k][a : a + n] for k in (0, 3, 7) for a, n in ((5, 1), (9, 15), (40, 60), (100, 900))] + ["nowhere at all, ever", ""]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    asked = spark.createDataFrame([*enumerate(phrases), (99, None)], "item_id long, phrase string")
    want = sorted((i, d, t.find(p), t.find(p) + len(p)) for i, p in enumerate(phrases) for d, t in enumerate(texts) if p in t)
    for most in (100_000, 4):
        assert sorted(map(tuple, D.phrase_hits(data, asked, most).collect())) == want


def test_files_with_converters_and_a_report(spark, tmp_path):
    root = tmp_path / "c++ (1)"
    (root / "build").mkdir(parents=True)
    (root / "a.pdf").write_bytes(b"%PDF one")
    (root / "b.docx").write_bytes(b"bad")
    (root / "c.pptx").write_bytes(b"slides")
    (root / "d.txt").write_text("plain")
    (root / "e.bin").write_bytes(b"\0")
    (root / "build" / "f.py").write_text("x = 1")
    (root / "g.py").write_text("y = 2")

    def pdf(raw):
        return f"# {raw.decode()[5:]}  \n"

    def docx(raw):
        raise ValueError("not a document")

    made = {r.path.rsplit("/", 1)[-1]: r for r in R.read_files(spark, str(root), converters={"pdf": pdf, "docx": docx}).collect()}
    assert set(made) == {"a.pdf", "d.txt", "f.py", "g.py"}
    assert made["a.pdf"].content == "# one" and made["a.pdf"].content_type == "pdf" and made["a.pdf"].metadata["parser"] == "converter"
    status = {r.path.rsplit("/", 1)[-1]: (r.status, r.error) for r in R.scan_report(spark, str(root), converters={"pdf": pdf, "docx": docx}).collect()}
    assert status["a.pdf"] == ("converted", None) and status["b.docx"] == ("failed", "ValueError: not a document")
    assert status["c.pptx"][0] == "no_converter" and status["e.bin"][0] == "unsupported" and status["d.txt"][0] == "read"
    assert {r.metadata["rel_path"] for r in R.read_repo(spark, str(root)).collect()} == {"d.txt", "g.py"}


def test_paths_are_confined(tmp_path):
    inside, outside = tmp_path / "in", tmp_path / "in2"
    inside.mkdir(), outside.mkdir()
    (inside / "link").symlink_to(outside)
    assert R.confined(str(inside / "x"), str(inside)) == str(inside / "x") and R.confined("x", str(inside)) == str(inside / "x")
    assert R.confined("s3://b/a/x", "s3://b/a") == "s3://b/a/x" and R.confined("/anywhere", None) == "/anywhere"
    for path, root in ((outside, inside), (inside / "link", inside), (inside / ".." / "in2", inside), ("s3://b/a/../c", "s3://b/a"), ("../in2", inside)):
        with pytest.raises(PermissionError):
            R.confined(str(path), str(root))


def test_addresses_that_are_not_public(spark):
    private = ["http://127.0.0.1/", "https://10.1.2.3:8080/x", "http://172.16.0.1", "http://172.31.9.9/", "http://192.168.1.1", "http://169.254.169.254/latest", "http://[::1]/", "http://[fd00::1]/", "http://localhost", "http://a:b@10.0.0.1/", "http://2130706433/", "file:///etc/passwd", "ftp://x.org", "http://"]
    public = ["http://example.org/10.0.0.1", "https://172.32.0.1/", "HTTP://11.0.0.1", "http://localhost.example.org/", "http://[2001:db8::1]/"]
    rows = spark.createDataFrame([(u,) for u in private + public], "url string").select("url", R.is_public(F.col("url")).alias("ok")).collect()
    assert [r.url for r in rows if r.ok] == public


def test_pages_that_are_not_html_stay_as_they_are(spark):
    pages = spark.createDataFrame([("http://a.org", "<p>x</p>  ", "text/plain"), ("http://b.org", "<nav>n</nav><p>y</p>", "text/HTML; charset=x")], "url string, html string, content_type string")
    got = {r.source_url: (r.content_type, r.content) for r in R.read_pages(pages).collect()}
    assert got == {"http://a.org": ("markdown", "<p>x</p>  "), "http://b.org": ("html", "<p>y</p>")}


def test_queries_of_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "set.yaml").write_text("queries:\n- question: q\n  document_id: d\n  answer_spans: [[0, 3], [5, 9]]\n  id: one\n")
    row = R.read_queries(spark, str(tmp_path / "set.yaml")).first()
    assert (row.dataset, row.query_id, row.doc_id, [tuple(s) for s in row.answer_spans]) == ("set", "one", "d", [(0, 3), (5, 9)])


def test_workspace(tmp_path):
    assert W.Workspace.read(folder=tmp_path) == W.Workspace()
    where = W.Workspace.write_defaults(tmp_path)
    assert W.Workspace.read(folder=tmp_path) == W.Workspace() and "api_key" not in where.read_text()
    with pytest.raises(FileExistsError):
        W.Workspace.write_defaults(tmp_path)
    where.write_text(json.dumps({"use_case": "search", "strip_patterns": ["x"], "api_base": "http://a"}))
    got = W.Workspace.read(where)
    assert got.use_case == "search" and got.strip_patterns == ("x",)
    assert got.provider({W.KEY_VARIABLE: "k", W.BASE_VARIABLE: "b"}) == ("http://a", "k") and W.Workspace().provider({}) == (None, None)
    assert W.Workspace(cache_dir="/c").cache({}) == "/c" and W.Workspace(cache_dir="/c").cache({W.CACHE_VARIABLE: "/d"}) == "/d"
    where.write_text(json.dumps({"colour": 1}))
    with pytest.raises(ValueError):
        W.Workspace.read(where)
    with pytest.raises(ValueError):
        W.checked_format("xml")


def test_selection_labels_and_gate(spark):
    r = S.REGISTRY
    assert r.selected() == ["fixed_tokens", "recursive_character"] and r.selected("semantic, agentic") == ["semantic", "agentic"]
    assert "agentic" not in r.selected(all_text=True) and "agentic" in r.selected(all_text=True, agentic=True)
    with pytest.raises(KeyError):
        r.selected("semantic,nope")
    assert {x.strategy: x.chosen for x in r.availability(spark, ["semantic"], "text").collect()}["semantic"]
    assert S.params_label(Config("recursive_character", {"chunk_size_chars": 8, "separators": ["."]})) == "8 chr / 0 ov own-sep"
    assert S.params_label(Config("semantic", {"max_tokens": 8})) == "8 tok / thr=0.00" and S.params_label(Config("code_window", {"a": 1})) == '{"a":1}'
    assert S.generation_gate("no_such_judge", ["K"], {"K": "1"}) == (False, "no_such_judge is not installed")
    assert S.generation_gate("json", ["K"], {}) == (False, "none of K is set") and S.generation_gate("json", ["K"], {"K": "1"}) == (True, "")


def test_sampled_checks(spark, docs):
    chunks = C.chunk(docs, [Config("fixed_tokens", {"max_tokens": 1})])
    assert C.sampled(chunks).count() == chunks.count() <= 500
    many = spark.range(2500).selectExpr("'c' AS config_id", "id AS doc_id", "0 AS chunk_idx")
    assert C.sampled(many).count() == 200 and sorted(C.sampled(many).collect()) == sorted(C.sampled(many.repartition(5)).collect())


def test_judge_of_recorded_answers(spark):
    rows = spark.createDataFrame([("c", "q1", "Q?", "ctx", None, "a"), ("c", "q2", "Q?", "ctx", "r", "bb")], "config_id string, query_id string, question string, context string, reference_answer string, answer string")

    def judge(frame):
        import pandas as pd

        return pd.DataFrame({"faithfulness": frame["answer"].str.len() / 2, "answer_relevancy": 0.5})

    got = V.judged_by(rows, judge)
    assert sorted(tuple(r) for r in got.collect()) == [("c", "q1", 0.5, 0.5), ("c", "q2", 1.0, 0.5)]
    means = V.with_generation(spark.createDataFrame([("c",)], "config_id string"), got).first()
    assert means.faithfulness == 0.75 and means.answer_relevancy == 0.5


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "in").mkdir()
    for i, t in enumerate(TEXTS[:3]):
        (tmp_path / "in" / f"{i}.txt").write_text(t)
    assert command.main([]) == 2 and "recommend" in capsys.readouterr().out
    assert command.main(["init"]) == 0 and (tmp_path / W.FILE).exists()
    capsys.readouterr()

    def run(*words):
        assert command.main([*words, "--format", "json"], spark) == 0
        return json.loads(capsys.readouterr().out)

    path = str(tmp_path / "in")
    assert len(run("analyze", path)) == 3 and run("estimate", path)[0]["strategy_configs"] == 27
    ranking = run("recommend", path, "--strategies", "fixed_tokens", "--report", str(tmp_path / "r.md"))
    assert ranking[0]["rank"] == 1 and ranking[0]["label"].endswith("ov") and (tmp_path / "r.md").read_text().startswith("| config_id")
    assert run("evaluate", path, "--strategy", "fixed_tokens", "--params", '{"max_tokens": 8}')[0]["rank"] == 1
    assert len(run("compare", path, "--strategies", "fixed_tokens,recursive_character")) == 2
    assert run("preview", path, "--strategy", "fixed_tokens", "--params", '{"max_tokens": 8}')[0]["chunk_idx"] == 0
    assert run("cache", str(tmp_path / "none")) == [{"entries": 0, "approx_bytes": 0}] and run("cache", "--clear", str(tmp_path / "none"))[0]["cleared"] is False
    with pytest.raises(SystemExit):
        command.main(["recommend", path, "--format", "xml"], spark)
    with pytest.raises(SystemExit):
        (tmp_path / "empty").mkdir()
        command.main(["recommend", str(tmp_path / "empty")], spark)


def test_samples(spark):
    from spanweave.sources.samples import sample_transcripts

    rows = D.anchored(sample_transcripts(spark), [("m", "operating margin", "?"), ("y", "year over year", "?")]).collect()
    assert {r.query_id for r in rows} == {"q_harbour_m", "q_orchard_y"}
