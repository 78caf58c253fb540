"""The pipeline, stage by stage, against plain Python on a small corpus."""

import random

import corpus_pipeline as P
from spanweave.llm import knn_quality

from . import brute


def test_stages_equal_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("th", "er", "on", "an", "ü") for b in ("ing", "ed", "ly", "é", "ou")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = {i: f"All rights reserved.\n{prose(rng.randint(60, 120))}\nown {i}" for i in range(30)}
    texts |= {i: " ".join(f"{rng.choice(words).upper()}!!" for _ in range(80)) for i in range(30, 45)}
    texts |= {50: texts[3], 51: texts[3], 52: prose(70) + ' token = "0123456789abcdef0123456789"', 53: None, 54: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 30)) for i in range(45)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    state = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        state[name] = docs.collect()
    assert [n for n, _ in P.STAGES] == list(state)
    kept = {r.doc_id: r.text for r in state["quality_classifier"]}
    assert set(kept) == set(texts) - set(range(30, 45))
    lines = {r.doc_id: r for r in state["line_dedup"]}
    want = {d: x for d, *x in brute.line_dedup(kept)}
    assert set(lines) == set(kept) and all(brute.sha(lines[d].text or "") == want[d][2] for d in lines)
    assert all(r.text is None or r.n_chars == len(r.text) for r in lines.values())
    first = {}
    for d in sorted(lines):
        first.setdefault(" ".join((lines[d].text or "").lower().split()), d)
    assert sorted(r.doc_id for r in state["simhash_near_dedup"]) == sorted(first.values())
    safe = {r.doc_id: r.text for r in state["secret_scans"]}
    assert safe[52].endswith("<assign>\"") or safe[52].endswith("<assign>") or "<assign>" in safe[52]
    assert all(brute.base_secrets(t)[:3] == (0, 0, 0) for t in safe.values())
    pieces = state["packing"]
    assert {r.doc_id for r in pieces} == set(safe)
    assert all(sum(r.length for r in pieces if r.doc_id == d) == next(r.doc_tokens for r in pieces if r.doc_id == d) for d in safe)
    assert P.run(spark, str(tmp_path)).count() == len(pieces)
    assert knn_quality.Fit().sample > 0 and P.ORACLE_SQL is None


ODD = "doc_id long, text string, lang string, source string, n_chars long, _score string, _lines string, _lost string, secrets string, node string, number string"


def test_odd_rows_and_clashing_columns_pass_through(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    long = "\n".join(prose(40) for _ in range(2500))
    texts = [(1, None), (2, ""), (None, prose(60)), (4, long), (5, prose(50) + " token = abcdef0123"), (5, prose(50)), (7, prose(30)), (7, "four words are short"), (8, "Four words are short")]
    texts[6] = texts[7] = (7, prose(30))
    rows = [(i, t, "en", "s", 7, "a", "b", "c", "d", "e", "f") for i, t in texts]
    spark.createDataFrame(rows, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.dtypes == spark.createDataFrame([], ODD).dtypes
        got = docs.collect()
        assert {r[5:] for r in got} == {("a", "b", "c", "d", "e", "f")}
        if name == "quality_classifier":
            assert len(got) == len(rows)
    by_id = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got)
    # Null and empty texts are copies, as are the repeated rows.
    assert [x[1] for x in by_id if not x[0]] == [1, 4, 5, 5, 7, 8] and sum(x[0] for x in by_id) == 1
    assert any("<assign>" in x[2] for x in by_id) and next(r.n_chars for r in got if r.doc_id == 4) == len(long)
    pieces = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.start == 0 for r in pieces) == len(got)
    none = docs.where("doc_id = -1")
    for _, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_packing_keeps_small_caches(spark):
    """More different words than a cache may hold, in one task; workers tell what they keep after it."""
    import gc
    import time

    import pyarrow as pa

    from spanweave.llm.units import GROUP, UnitEncoder

    def word(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(5))

    texts = [" ".join(word(i) for i in range(at, at + 2_000)) for at in range(0, 300_000, 2_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    pieces = P.packed(spark, docs, "").collect()
    assert {r.doc_id for r in pieces} == set(range(len(texts)))

    def kept(batches):
        for batch in batches:
            time.sleep(0.2)
            sizes = [len(c) for x in gc.get_objects() if isinstance(x, UnitEncoder) for c in (x.after_space, x.spaced, x.bare)]
            yield pa.RecordBatch.from_arrays([pa.array([max(sizes, default=0)] * batch.num_rows, pa.int64())], names=["n"])

    most = max(r.n for r in spark.range(0, 16, 1, 16).mapInArrow(kept, "n long").collect())
    assert 0 < most <= P.CACHED + GROUP // 6
