from pyspark.sql import functions as F

from spanweave.llm import byte_bpe, components, html_text, knn_quality, line_dedup, matroska, packing, quality_rules, secret_scan, simhash, suffix_dedup
from spanweave.llm.trigrams import trigram_query

from . import brute


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# 1
def test_quality_counts_and_hosts(docs, texts, odd, empty):
    got = quality_rules.quality_rules(docs)
    counts = {r[0]: r[1:] for r in rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    assert counts == {i: brute.quality_counts(t) for i, t in enumerate(texts)}
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(odd).count() == 6
    assert quality_rules.quality_rules(empty).count() == 0


def test_bad_host_is_shrunk_and_rejected(spark):
    good = " ".join(f"w{i}" for i in range(60))
    data = [(i, good, "good") for i in range(40)] + [(i, "bad", "bad") for i in range(40, 79)] + [(79, good, "bad"), (80, "bad", "one")]
    got = quality_rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, source string"))
    kept = dict(rows(got, "doc_id", "kept"))
    hosts = {r.host: r.host_kept for r in got.collect()}
    assert hosts == {"good": True, "bad": False, "one": hosts["one"]} and kept[0] and not kept[79]


# 2
def test_packing_places_each_id_once(spark, docs, texts, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, window=64).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, len(r.ids) // 4))
    for i, t in enumerate(texts):
        want = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[i])
        assert b"".join(p[1] for p in parts) == b"".join(x.to_bytes(4, "little") for x in want)
        assert {p[2] for p in parts} == {len(want)} and parts[0][0] == 0
    for parts in by_seq.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_has_the_ids_of_the_library_around_special_tokens(spark, odd):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path, mark = P.path("byte_bpe_50k.json"), "<|endoftext|>"
    model = Tokenizer.from_file(path)
    texts = [f"a {mark} b", f"{mark}{mark}", f"x   {mark}   y", f"\n \n{mark} \t  end  ", f"{mark[:-1]} <|END|>", f"é  {mark}", f"{mark}\u00a0 z"]
    got = {}
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sorted(packing.pack_documents(data, path, window=8).collect(), key=lambda r: r.start):
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    for i, t in enumerate(texts):
        assert got[i] == b"".join(x.to_bytes(4, "little") for x in [*model.encode(t, add_special_tokens=False).ids, 0]), t
    # Null ids and repeated rows are packed once each.
    assert sum(r.start == 0 for r in packing.pack_documents(odd, path).collect()) == 6


def test_unit_encoders_equal_the_libraries_on_mixed_texts(monkeypatch):
    import base64
    import random

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    from spanweave.llm import units

    rng = random.Random(12)
    parts = ["word", "Été", "ß", "don't", "I'll", "x1", "42", ".", ",", "?!", "###", " ", "  ", "\n", "\n\n", "\t", "\r\n", " \n ", "\u00a0", "\u3000", "\u0301", "日本", "Ω", "'s", "_", "&", "a" * 50, "é\nÀb", "😀", "ʼ", "\x1c", "\x85"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    as_bytes = lambda ids: b"".join(x.to_bytes(4, "little") for x in ids)
    monkeypatch.setattr(units, "GROUP", 300)
    packed = list(packing._json_encoder.__wrapped__(P.path("byte_bpe_50k.json"))(texts))
    bpe = byte_bpe.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    bpe.encode.most = 200
    for t, a, b in zip(texts, packed, bpe.encode.each(texts), strict=True):
        assert a == as_bytes(model.encode(t, add_special_tokens=False).ids), t
        assert b == as_bytes(own.encode_ordinary(t)), t


def test_packing_ties_go_to_the_fullest_level():
    levels = packing.LevelArray(10)
    for n, size in enumerate((3, 5)):
        levels.open.setdefault(size, []).append([(n, 0, b"0000" * size, size)])
        levels.counts[size] += 1
    # A piece of 1 on level 3 or 5 leaves the same sum of squares.
    assert levels.place(1) == 5


def test_level_array_takes_the_least_sum_of_squares():
    import random

    rng = random.Random(3)
    levels = packing.LevelArray(32)
    for n in range(400):
        size = rng.randint(1, 31)
        counts = levels.counts.copy()

        def cost(h):
            after = counts.copy()
            if h:
                after[h] -= 1
            if h + size < 32:
                after[h + size] += 1
            return int((after[1:32] ** 2).sum())

        chosen = levels.place(size)
        assert cost(chosen) == min(cost(h) for h in range(33 - size) if h == 0 or counts[h])
        levels.add((n, 0, b"0000" * size, size), size)


# 3
def test_bpe_equals_the_library_and_round_trips(docs, texts, odd, empty):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.encode_documents(docs, path, P.PATTERN, as_text=True).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i].ids == " ".join(map(str, ids)) and got[i].n_tokens == len(ids) and bytes(got[i].decoded) == (t or "").encode()
    assert byte_bpe.encode_documents(odd, path, P.PATTERN).count() == 6
    assert byte_bpe.encode_documents(empty, path, P.PATTERN).count() == 0


# 4
def test_secrets_equal_brute_force(docs, texts, odd, empty):
    got = {r.doc_id: r.secrets for r in secret_scan.find_secrets(docs).collect()}
    for i, t in enumerate(texts):
        base = [s for s in got[i] if s.order < 3]
        counts = [sum(s.kind == k for s in base) for k in brute.SECRETS]
        assert (*counts, brute.sha(",".join(f"{s.kind}:{s.start}:{s.end}" for s in base))) == brute.base_secrets(t)
    found = secret_scan.find_secrets(odd)
    assert found.count() == 6 and found.columns.count("secrets") == 1
    assert secret_scan.find_secrets(empty).count() == 0


def test_added_rules_and_masking(spark):
    text = "é ghp_" + "z9" * 20 + " xoxb-1234567890ab token=ghp_" + "y8" * 20 + " -----BEGIN RSA PRIVATE KEY----- ok"
    found = secret_scan.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    row = found.select("secrets", secret_scan.masked(F.col("text"), F.col("secrets")).alias("m")).first()
    assert {s.kind for s in row.secrets} == {"forge", "chat", "assign", "pem"}
    assert row.m == "é <forge> <chat> <assign> <pem> ok"


def test_texts_that_are_costly_to_match(spark):
    import time

    texts = ["-----BEGIN " + "AB " * 20_000 + "PRIVATE KEY-----", "eyJ" * 60_000, "-----BEGIN " + "A" * 200_000, "token" + " " * 200_000, "secret=" * 20_000]
    texts += ["ab12" * 50_000 + "g", ("x0" * 12 + " token=abcdef ") * 300, "AKIA" * 50_000]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r for r in secret_scan.find_secrets(data).collect()}
    assert [s.kind for s in got[0].secrets] == ["pem"] and got[0].secrets[0].end == len(texts[0])
    for i, t in enumerate(texts):
        base = [s for s in got[i].secrets if s.order < 3]
        assert (*(sum(s.kind == k for s in base) for k in brute.SECRETS), brute.sha(",".join(f"{s.kind}:{s.start}:{s.end}" for s in base))) == brute.base_secrets(t)
    many = [" é ".join(f"token=abc{i:05d}" for i in range(30_000)), "x" * 2048 + " token=abcdef" + " y" * 1024]
    start = time.time()
    long = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    assert [r.text for r in secret_scan.mask_secrets(long).orderBy("doc_id").collect()] == [" é ".join(["<assign>"] * 30_000), "x" * 2048 + " <assign>" + " y" * 1024]
    masked = {r.doc_id: r.text for r in secret_scan.mask_secrets(data).collect()}
    assert masked[0] == "<pem>" and masked[6] == ("x0" * 12 + " <assign> ") * 300 and masked[1] == texts[1]
    assert time.time() - start < 60


def test_callers_columns_are_left_as_they_are(odd):
    masked = secret_scan.mask_secrets(odd)
    assert masked.columns == odd.columns and {r.secrets for r in masked.collect()} == {3}


def test_trigram_regex_finds_overlapping_ones():
    import re

    from spanweave.llm.trigrams import any_of

    grams = {"abc", "bcd", "b.d", "---", "a]c", "x\\y"}
    text = "abcd b.d bxd ----- a]c x\\y"
    assert [m[1] for m in re.finditer(any_of(grams), text)] == ["abc", "bcd", "b.d", "---", "---", "---", "a]c", "x\\y"]


def test_trigram_queries():
    assert trigram_query("[0-9a-f]+") is None
    assert trigram_query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert trigram_query("(abcd|xyz)q?") == {frozenset({"abc", "bcd"}), frozenset({"xyz"}), frozenset({"abc", "bcd", "cdq"}), frozenset({"xyz", "yzq"})}
    assert trigram_query("ab[0-9]{2}cd") is None
    assert trigram_query("(?:foo)+bar") == {frozenset({"foo", "bar"})}


# 5
def test_line_dedup_equals_brute_force(docs, texts, odd, empty):
    got = line_dedup.dedup_lines(docs, min_docs=5).collect()
    want = {d: x for d, *x in brute.line_dedup(dict(enumerate(texts)), 5)}
    assert sum(x[1] for x in want.values()) > 0
    for r in got:
        assert [r._lines, r._lost, brute.sha(r.text or "")] == want[r.doc_id]
    again = line_dedup.dedup_lines(odd, min_docs=2)
    assert again.count() == 6 and again.columns.count("_lines") == 1
    assert line_dedup.dedup_lines(empty).count() == 0


def test_long_documents_and_all_lines_lost(spark):
    many = "\n".join(f"line {i % 300}" for i in range(3000))
    data = spark.createDataFrame([(i, many) if i < 3 else (i, "line 5\nown") for i in range(4)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(data, min_docs=3).collect()}
    assert got[0]._lost == 3000 and got[0].text == "" and got[3].text == "own"


# 6
def test_simhash_equals_brute_force(docs, texts, odd, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = {i: brute.fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == brute.near(prints)
    names = rows(simhash.near_duplicates(odd), "doc_id", "component_id")
    assert sorted(names, key=str) == sorted([(None, 5), (None, 5), (5, 5), (5, 5), (5, 5), (6, 6)], key=str)
    assert simhash.near_duplicates(empty).count() == 0


def test_near_duplicates_send_no_table_through_the_driver(spark, docs, monkeypatch):
    """Small tables would be broadcast if joins left it to the planner, and so would large ones whose files are small."""
    plans = []

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return spool(df, label)

    spool = simhash.spool
    monkeypatch.setattr(simhash, "spool", seen)
    monkeypatch.setattr(components, "spool", seen)
    last = simhash.near_duplicates(docs)
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) >= 6 and not any("Broadcast" in p for p in plans)


def test_one_of_each_group_of_near_copies(spark, odd, empty):
    import random

    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    base = [prose(200) for _ in range(12)]
    texts = {i: " ".join(b) for i, b in enumerate(base)}
    for i in range(12):
        near = list(base[i])
        near[rng.randrange(200)] = "changed"
        texts[100 + i] = " ".join(near)
        far = [w if k % 6 else "x" for k, w in enumerate(base[i])]
        texts[200 + i] = " ".join(far)
    texts |= {300: texts[0], 301: texts[0].upper(), 302: None, 303: " "}
    data = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.first_of_each(data).collect()}
    # All that are no copies stay; nearly all near copies go, exact ones always.
    assert {*range(12), *range(200, 212), 302} <= kept and not kept & {300, 301, 303}
    assert len(kept & set(range(100, 112))) <= 1
    assert simhash.first_of_each(odd).count() == 3 and simhash.first_of_each(odd).columns == odd.columns
    assert simhash.first_of_each(empty).count() == 0


def _first_of_near(texts, width=5):
    """Smallest ids of the components of all pairs with 0.8 or more of their shingles in common."""
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in sets}


def test_large_groups_of_one_base_lose_no_link(spark, monkeypatch):
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    texts = {}
    for i in range(300):
        at = rng.randrange(len(base) - 20)
        texts[i] = " ".join(base[:at] + [f"own{i}x{k}" for k in range(rng.randint(1, 18))] + base[at + rng.randint(1, 18) :])
    data = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = _first_of_near(texts)
    assert 1 < len(want) < len(texts)
    assert {r.doc_id for r in simhash.first_of_each(data).collect()} == want
    # Tiles alone, and with tiles of few members.
    monkeypatch.setattr(simhash, "HUBS", 0, raising=False)
    monkeypatch.setattr(simhash, "TILE", 40, raising=False)
    assert {r.doc_id for r in simhash.first_of_each(data).collect()} == want


def test_pairs_just_over_the_similarity_are_all_found(spark):
    import random

    rng = random.Random(8)
    texts = {}
    for i in range(150):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice((8, 30, 90, 250)))]
        near = list(base)
        for _ in range(max(1, len(base) // rng.choice((40, 48, 60)))):
            near[rng.randrange(len(near))] = f"new{rng.randrange(900)}"
        texts |= {2 * i: " ".join(base), 2 * i + 1: " ".join(near)}
        if i % 3 == 0:
            texts[2 * i + 1] = " ".join(base + near[: len(base) // 4])
    data = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = _first_of_near(texts)
    assert 150 < len(want) < 300
    assert {r.doc_id for r in simhash.first_of_each(data).collect()} == want


def test_near_copies_come_from_fingerprints_before_the_exact_filter(spark, monkeypatch):
    import random

    rng = random.Random(4)
    texts, near = {}, set()
    for i in range(40):
        base = [f"w{rng.randrange(4000)}" for _ in range(400)]
        edited = [*base[:-1], "new"] if i % 2 else [*base[:200], "new", *base[201:]]
        texts |= {2 * i: " ".join(base), 2 * i + 1: " ".join(edited)}
        a, b = (simhash.fingerprint(texts[k], 5) for k in (2 * i, 2 * i + 1))
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
            near.add(2 * i + 1)
    # Repeats give these one fingerprint, but few of their shingles are shared.
    for k in (100, 101):
        texts[k] = "a b c d e " * 400 + " ".join(f"own{k}x{n}" for n in range(40))
    assert simhash.fingerprint(texts[100], 5) == simhash.fingerprint(texts[101], 5)
    data = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.first_of_each(data).collect()} == _first_of_near(texts) == {*range(0, 80, 2), 100, 101}
    # Without the filter that follows, near fingerprints still give their verified links, and no others.
    monkeypatch.setattr(simhash, "_prefixes", lambda *_: spark.createDataFrame([], "key long, id long, size int"))
    assert 5 < len(near) < 40
    assert {r.doc_id for r in simhash.first_of_each(data).collect()} == set(texts) - near


def test_crowded_cells_and_chains_lose_no_link(spark, monkeypatch):
    import random

    rng = random.Random(5)
    words = []
    for base in (rng.getrandbits(64) for _ in range(3)):
        at = base
        for _ in range(60):
            words.append(at)
            at = rng.choice([at, at, base])
            for _ in range(rng.randint(1, 3)):
                at ^= 1 << rng.randrange(64)
    # A dense ball: its cells are crowded on all grids but the last.
    words += [words[0] ^ 1 << a ^ 1 << b for a in range(0, 64, 3) for b in range(a, 64, 7)]
    words += [0, (1 << 64) - 1, 3, 1 << 63]
    data = spark.createDataFrame([(i, w - (1 << 64) if w >> 63 else w) for i, w in enumerate(words)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda d, width=3: d)
    got = dict(rows(simhash.near_duplicates(data), "doc_id", "component_id"))
    assert got == brute.near(dict(enumerate(words)))
    # Each grid alone, and pairs alone, give the same.
    for segments, members in (((1,), 12), ((4, 1), 2), ((4, 2, 1), 1 << 30)):
        monkeypatch.setattr(simhash, "SEGMENTS", segments)
        monkeypatch.setattr(simhash, "MEMBERS", members)
        assert dict(rows(simhash.near_duplicates(data), "doc_id", "component_id")) == got


def test_copies_that_share_a_hub_which_neither_is_near_to(spark):
    """A text, the same with two neighbouring words swapped, and a shuffled copy of the same words."""
    import random

    rng = random.Random(6)
    texts = {}
    for i in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        at = rng.randrange(118)
        swapped = [*base[:at], base[at + 1], base[at], *base[at + 2 :]]
        mixed = rng.sample(base, len(base))
        texts |= dict(zip(rng.sample((3 * i, 3 * i + 1, 3 * i + 2), 3), (" ".join(x) for x in (base, swapped, mixed))))
    data = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = _first_of_near(texts)
    assert len(want) == 120 and {r.doc_id for r in simhash.first_of_each(data).collect()} == want


# 7
def test_media_round_trip(docs, texts, empty):
    for r in matroska.store_texts(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert bytes(r.payload) == matroska.padded(raw) and r.n_bytes == len(raw) and r.error is None
    assert matroska.store_texts(empty).count() == 0


def test_laces_unknown_sizes_and_damage():
    payload = bytes(range(256)) * 400
    media = matroska.write(payload)
    whole = matroska.read(media)
    assert b"".join(media[p[2] : p[2] + p[3]] for p in whole.packets) == payload
    assert [c[2] for c in whole.cues] == whole.clusters and len(whole.clusters) == 4
    assert [p[1] for p in whole.packets] == list(range(0, len(payload), matroska.FRAME))
    cut = matroska.read(media[: len(media) // 2])
    assert cut.error and 0 < len(cut.packets) < len(whole.packets)
    for kind in (matroska.XIPH, matroska.EBML_LACE):
        sizes = [3, 700, 255, 0, 19]
        body = bytes(sum(sizes))
        block = matroska.vint(2) + (5).to_bytes(2, "big") + bytes([kind << 1]) + matroska.lace(sizes, kind) + body
        unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
        cluster = unknown + matroska.element(matroska.TIME, 100) + matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, block))
        file = matroska.element(matroska.SEGMENT, cluster + unknown + matroska.element(matroska.TIME, 9))
        m = matroska.read(file)
        assert [p[3] for p in m.packets] == sizes and {p[:2] for p in m.packets} == {(2, 105)} and len(m.clusters) == 2


def test_odd_files_are_read_in_linear_time():
    import time

    unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    block = lambda track: matroska.element(matroska.SIMPLE, matroska.vint(track) + b"\0\0\x80" + b"data")
    live = unknown + matroska.element(matroska.TIME, 5) + block(1)
    start = time.time()
    m = matroska.read(matroska.element(matroska.SEGMENT, live * 20_000))
    assert len(m.packets) == len(m.clusters) == 20_000 and m.error is None and time.time() - start < 20
    late = unknown + matroska.element(matroska.TIME, 1 << 75) + block(1)
    far = unknown + matroska.element(matroska.TIME, 5) + block(1 << 40)
    cut = unknown + matroska.element(matroska.TIME, 5) + block(1) + block(1)[:-2]
    for damaged, packets in ((late, 1), (far, 1), (cut, 2), (unknown + b"\0", 1)):
        m = matroska.read(matroska.element(matroska.SEGMENT, live + damaged))
        assert len(m.packets) == packets and m.error, damaged
    last = matroska.read(matroska.element(matroska.SEGMENT, live + unknown + matroska.element(matroska.TIME, (1 << 63) - 1) + block(1)))
    assert [p[1] for p in last.packets] == [5, (1 << 63) - 1] and last.error is None


def test_files_equal_an_independent_reader(texts):
    for t in texts:
        raw = matroska.padded((t or "").encode())
        assert brute.matroska_samples(matroska.write(raw)) == raw
    big = bytes(range(256)) * 300 + b"\7" * 64
    assert brute.matroska_samples(matroska.write(big)) == big


def test_packet_table_of_damaged_files(spark, odd):
    unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    late = matroska.element(matroska.SEGMENT, unknown + matroska.element(matroska.TIME, 1 << 75))
    far = matroska.element(matroska.SEGMENT, unknown + matroska.element(matroska.SIMPLE, matroska.vint(1 << 40) + b"\0\0\x80abc"))
    data = spark.createDataFrame([(None, bytearray(late)), (1, bytearray(far)), (1, bytearray(far))], "media_id long, media binary")
    got = matroska.packet_table(data).collect()
    assert len(got) == 3 and all(r.error for r in got)
    stored = matroska.store_texts(odd).collect()
    assert len(stored) == 6 and len({bytes(r.media) for r in stored}) == 3 and sum(r.doc_id is None for r in stored) == 2


def test_packet_table(spark):
    media = spark.createDataFrame([(1, bytearray(matroska.write(b"x" * 5000))), (2, bytearray(b"junk")), (3, None)], "media_id long, media binary")
    got = matroska.packet_table(media).collect()
    assert sum(r.length for r in got if r.media_id == 1) == 5000 and {r.media_id for r in got if r.error} == {2}


# 8
def test_html_articles(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
<div class="sidebar"><p>Side text, with words. More.</p></div><article><header><h1>Head &amp; more</h1></header><p>This is the <b>text</b>, and
it goes on.<br>It has words; many.<ul><li>one, two.<li>three.</ul><aside>Not this.</aside><form>Search <input></form>
<div class="body no-sidebar"><p>In it.</p></div><article class="comment"><p>Me too, always.</p></article><div class="ad">Buy now, please.</div><div id="comments"><p>Nice post, really.</p></div></article><div class="cookie-notice">We use cookies.</div>
<script>var t="</p>";</script><footer>&copy; all</footer>"""
    plain = page.replace("<article>", '<div class="post">').replace("</article>", "</div>")
    want = "Head & more This is the text, and it goes on. It has words; many. one, two. three. In it."
    data = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, None, plain), (5, "u", "<p>Cut off, he<b"), (1, "u", page)], "page_id long, url string, html string")
    got = rows(html_text.extract_pages(data), "page_id", "text")
    assert got[0] == got[5] == (1, want) and got[1][1] == got[2][1] == "" and got[4][1] == "Cut off, he"
    assert got[3][1] in (want, want.removeprefix("Head & more "))


def test_html_content_beside_the_largest_element_stays():
    said = [f"Sentence {i} goes on, and on; it ends here." for i in range(20)]
    body = "".join(f"<p>{x}</p>" for x in said)
    rest = " ".join(said)
    lead = "The lead is prose, with a point."
    split = f"<body><div><h1>Title</h1><p>{lead}</p></div><div>{body}</div><div><p>The end, at last.</p></div><footer>No.</footer></body>"
    assert html_text.main_text(split) == f"Title {lead} {rest} The end, at last."
    beside = f"<body><main><article><p>{lead}</p></article><article>{body}</article></main><nav>No.</nav></body>"
    assert html_text.main_text(beside) == f"{lead} {rest}"
    half = f"<body><main><article>{body}</article><section><p>{rest}</p></section></main><div class=ad>No.</div></body>"
    assert html_text.main_text(half) == f"{rest} {rest}"


SAID = [f"Sentence {i} goes on, and on; it ends here." for i in range(12)]
BODY = "".join(f"<p>{x}</p>" for x in SAID)
ALL = " ".join(SAID)
NAV = "<div><ul>" + "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(8)) + "</ul></div>"
#: (page, its text)
PAGES = [
    (f"<html><body>{NAV}<div><h1>Title</h1>{BODY}</div><div>Terms</div></body></html>", f"Title {ALL}"),
    (f"<body><h1>Title</h1>{BODY}<ul><li>one</li><li>two</li></ul><div>Imprint</div></body>", f"Title {ALL} one two"),
    (f"<body>{NAV}<article><h2>Head</h2>{BODY}<figure><figcaption>A caption</figcaption></figure><ul><li><a href=/>A source</a></li></ul></article><div><p>Sign up.</p></div></body>", f"Head {ALL} A caption A source"),
    (f"<body><main><h1>Title</h1><div>{BODY}</div><section><h2>More</h2><p>{SAID[0]}</p></section></main>{NAV}</body>", f"Title {ALL} More {SAID[0]}"),
    (f"<body><div><h1>Title</h1><div>{BODY}</div></div>{NAV}</body>", f"Title {ALL}"),
    (f"<body><div class='post'><blockquote>{BODY}</blockquote><pre>x = 1\n y</pre><p>Last, <em>and</em> least.</p></div>{NAV}<footer><p>Made by us, in here; always.</p></footer></body>", f"{ALL} x = 1 y Last, and least."),
    (f"<body><div><p>Teaser</p></div><div>{BODY}<p><a href=/x>One whole sentence, linked; it stays.</a></p><table><tr><td>1</td><td>2</td></tr></table></div></body>", None),
    (f"<body><div>{BODY}</div><div id='comments'>{BODY}</div><div class='cookie-notice'><p>We use them, yes.</p></div></body>", ALL),
    (f"<body><article>{BODY}<article class='comment'>{BODY}</article></article><article><p>{SAID[3]}</p></article></body>", f"{ALL} {SAID[3]}"),
    (f"<body><section><div><span>&lt;b&gt; &amp; c,</span> {SAID[0]}</div><div>{SAID[1]}</div></section><nav>{BODY}</nav></body>", f"<b> & c, {SAID[0]} {SAID[1]}"),
    ("<body><p>Only this.</p></body>", "Only this."),
    (f"<body><div class='site-header'><h1>Site</h1><p>We write, daily; always.</p></div><div class='entry-header'><h1>Title</h1></div><div>{BODY}</div></body>", f"Title {ALL}"),
    (f"<body><div class=logo><h1>Site</h1></div><div><h1><a href=/>Title</a></h1><div>{BODY}</div></div></body>", f"Title {ALL}"),
    (f"<body><div id=header><p>We write, daily; always.</p></div><article><div class=header><h1>Title</h1></div>{BODY}</article></body>", f"Title {ALL}"),
]


def test_pages_equal_brute_force_and_what_they_say():
    for page, want in PAGES:
        for share in (0, 0.2, html_text.SHARE, 2):
            assert html_text.main_text(page, share) == brute.main_text(page, share), (share, page)
        assert want is None or html_text.main_text(page) == want


def test_fused_weights_of_paths_choose_the_nodes():
    page = f"<body>{NAV}<div><div>Half a line</div></div><section>{BODY}</section><div><div>All rights</div></div></body>"
    paths = html_text.content_paths(html_text.parse(page))
    assert len(paths) == 1 and html_text.main_text(page) == ALL
    assert html_text.main_text(page, 0).endswith(f"Half a line {ALL} All rights")


def test_odd_pages_are_read_in_linear_time(spark, empty):
    import time

    start = time.time()
    unmatched = '<p>It goes <a href="x>link</a> on, and on.</p>' * 30_000
    assert html_text.main_text(unmatched) == " ".join(["It goes link on, and on."] * 30_000)
    for page in ("<div>a, " * 50_000, "<b><table>" + "<div>" * 50_000 + "x. " + "</b>" * 50_000, "<" * 300_000, '<a b="' * 150_000, "<a " + "b=c " * 200_000, "<!--" * 100_000, "<p title='" * 80_000 + "'"):
        html_text.main_text(page)
    assert time.time() - start < 30
    assert html_text.main_text('<p>One <a href="x>link</a> two, three.</p><p class="a">More &lt; words.') == "One link two, three. More < words."
    data = spark.createDataFrame([(None, None, "<p>Text, here.</p>", "k", 1, 2)] * 2, "page_id long, url string, html string, text string, n_chars int, path int")
    assert rows(html_text.extract_pages(data), "page_id", "url", "text") == [(None, None, "Text, here.")] * 2
    assert html_text.extract_pages(data.where("page_id = 0")).count() == 0


# 9
def test_votes_follow_labels_of_the_training_rows(spark, empty):
    import random

    rng = random.Random(1)
    words = [f"{a}{b}" for a in "btkmn" for b in ("ing", "er", "al", "o")]
    good = lambda: " ".join(rng.choice(words) for _ in range(80))
    bad = lambda: " ".join(f"{rng.choice(words).upper()}!!" for _ in range(80))
    data = [(i, good() if i % 3 else bad()) for i in range(240)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(7, None), (None, 1)], "doc_id long, quality int")
    model = knn_quality.trained_on(docs, labels)
    got = dict(rows(knn_quality.score_documents(docs, model), "doc_id", "score"))
    assert all((got[i] >= 0.3) == (i % 3 > 0) for i in range(240)) and got[500] == got[501] == 0.5
    assert all(0 <= s <= 1 for s in got.values())
    none = knn_quality.trained_on(docs, labels.where("quality = 1"))
    assert none is None and set(dict(rows(knn_quality.score_documents(docs, none), "doc_id", "score")).values()) == {0.5}
    assert knn_quality.score_documents(empty, model).count() == 0


# 10
def test_repeats_equal_brute_force(docs, texts, odd, empty):
    got = suffix_dedup.remove_repeats(docs, 100).collect()
    want = {d: x for d, *x in brute.repeats(dict(enumerate(texts)))}
    assert sum(x[1] for x in want.values()) > 1000
    for r in got:
        mine = [r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), brute.sha(bytes(r.kept))]
        assert mine == want[r.doc_id], r.doc_id
    assert suffix_dedup.remove_repeats(odd).count() == 6
    assert suffix_dedup.remove_repeats(empty).count() == 0


def _as_brute(got):
    return {r.doc_id: [r.n_bytes, sum(x.stop - x.start for x in r.spans), len(r.spans), brute.sha(bytes(r.kept))] for r in got}


def test_small_alphabets_and_large_buckets(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(900)) for _ in range(3)]
    texts += [texts[0][200:700] + texts[1][100:450], "a" * 700, "abc" * 250, texts[2], "ü" * 300]
    passage = "".join(rng.choice("abcdefgh") for _ in range(150))
    texts += ["".join(rng.choice("wxyz") for _ in range(60)) + passage + "".join(rng.choice("uv") for _ in range(60)) for _ in range(60)]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {d: x for d, *x in brute.repeats(dict(enumerate(texts)))}
    assert _as_brute(suffix_dedup.remove_repeats(data).collect()) == want
    # Buckets that are cut once they are too large, or at once; small blocks; nothing held back.
    for bounds in (suffix_dedup.Bounds(bucket=3), suffix_dedup.Bounds(bucket=2, common=1, block=500, held=1)):
        assert _as_brute(suffix_dedup.remove_repeats(data, bounds=bounds).collect()) == want


def test_anchors_are_the_same_across_chunks(monkeypatch):
    import random

    rng = random.Random(2)
    raw = "".join(rng.choice("abc") for _ in range(5000)).encode()
    whole = suffix_dedup.anchors(raw, 100)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 512)
    cut = suffix_dedup.anchors(raw, 100)
    starts = lambda runs: [(h, p, s) for h, p, a, b in zip(*runs, strict=True) for s in range(a, b)]
    assert [x[1:] for x in starts(whole)] == [x[1:] for x in starts(cut)] and [x[2] for x in starts(whole)] == list(range(4901))


def test_suffixes_are_sorted_with_a_difference_cover():
    import random

    import numpy as np

    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))
    rng = random.Random(4)
    for period in (1, 2, 3, 13, 400):
        base = "".join(rng.choice("ab") for _ in range(period))
        raw = (base * 900)[:900] + "".join(rng.choice("ab") for _ in range(300)) + (base * 700)[:700]
        text = np.frombuffer(raw.encode() + bytes(64), dtype=np.uint8)
        where = np.arange(len(raw) - 100)
        order, _ = suffix_dedup.suffix_order(text, where, where // 1000, 100)
        assert [(i // 1000, raw[i : i + 100]) for i in order] == sorted((i // 1000, raw[i : i + 100]) for i in where)


def test_votes_of_tied_neighbours_and_odd_rows(spark, odd):
    import numpy as np

    fit = knn_quality.Fit(neighbours=2, rank=4)
    texts = ["one two three"] * 4 + ["four five six!"] * 3
    model = knn_quality.fit_model(texts, [1, 1, 0, 0, 0, 0, 0], fit)
    row = knn_quality.features("one two three", fit.buckets)[None]
    # All four equal texts vote, though two neighbours are asked for; each class weighs a half in all.
    want = (2 * 0.5 / (2 / 7)) / (2 * 0.5 / (2 / 7) + 2 * 0.5 / (5 / 7))
    assert abs(knn_quality.vote(model, row)[0] - want) < 1e-6
    many = np.repeat(row, 700, axis=0)
    assert len(set(knn_quality.vote(model, many).tolist())) == 1
    got = knn_quality.score_documents(odd, model, "score").collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and got[0].asDict().keys() == dict.fromkeys(odd.columns).keys()
    kept = knn_quality.keep_good(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == 6


def test_passes_give_memory_back():
    """What a pass has freed goes back to the system, even below something that stays."""
    import subprocess
    import sys

    code = """
from spanweave.llm.common import lean
from pathlib import Path
import re
stays = []
def held():
    return int(re.search(r"VmRSS:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024
def run(batches):
    for batch in batches:
        some = [bytes(2000) for _ in range(100_000)]
        stays.append(bytes(2000))
        yield held()
before = held()
most = max(lean(run)([1]))
assert most > before + 150, (before, most)
assert held() < before + 50, (before, most, held())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)
