"""Suffix-array dedup with a cover sample, one suffix bucket at a time (operator 10).

Every byte goes that a string of ``length`` bytes covers which also starts
earlier: in a smaller document id, or earlier in the same document.

Suffixes are dealt into buckets by the leftmost smallest hash among the
``K``-byte substrings of their first ``length`` bytes (their anchor), so equal
strings meet, neighbours share a bucket as one piece of text, and a bucket whose
anchor occurs once holds no repeat and is never built.  Within a task, buckets
are sorted one after the other, a block of them at a time: by their first bytes,
then by the ranks of a difference-cover sample, which is sorted once for the
block and settles ties of any length, as two positions always have sample
positions at one small distance behind both.

Equal pieces, which make up long repeats and groups of copies, collapse to
their first occurrence within each task before any exchange, and again in
their bucket; only first ones are dealt by bucket.

Memory is bounded by ``Bounds``.  A bucket with more pieces than that isn't
built: its pieces are cut into quarters by the place of the anchor in the string,
each quarter is dealt again by all the bytes that its strings share (more and
more of them, at last the whole string), and so on.  Anchors known to be very
common start with quarters.

Defined results: a null or empty text has no bytes; a document is a pair of id
and text, so identical repeated rows are one document and get one result; a
null id sorts before all others; ids that repeat with different texts sort by a
hash of the text; an empty table gives an empty result; only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spool, table, text_of, unspool

K = 24
#: A period and residues whose differences are all residues.
PERIOD = 13
COVER = (0, 1, 3, 9)
#: Bytes of a text hashed at once; positions within fit the low bits of a key.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Bounds:
    #: Different pieces of a bucket that are sorted together.
    bucket: int = 4096
    #: Occurrences of an anchor beyond which its pieces are cut at once.
    common: int = 50_000
    #: Bytes of pieces that one block sorts, one bucket more at most.
    block: int = 2_000_000
    #: Bytes of pieces that a task holds back before an exchange.
    held: int = 48_000_000


NULL_ID = -(1 << 63)


def _hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``K``-byte substring."""
    g = np.uint64(0x9E3779B97F4A7C15)
    h1 = raw.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        p2 = g * g
        p4 = p2 * p2
        p8 = p4 * p4
        h2 = h1[:-1] * g + h1[1:]
        h4 = h2[:-2] * p2 + h2[2:]
        h8 = h4[:-4] * p4 + h4[4:]
        h16 = h8[:-8] * p8 + h8[8:]
        h = h16[:-8] * p8 + h8[16:]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def _hash_at(raw: bytes, pos: np.ndarray) -> np.ndarray:
    """What ``_hashes`` gives for the substrings at ``pos``."""
    data = np.frombuffer(raw, dtype=np.uint8)
    h = np.zeros(len(pos), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(K):
            h = h * np.uint64(0x9E3779B97F4A7C15) + data[pos + k] + np.uint64(1)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first start, end of starts) of each run of strings with one anchor."""
    parts = []
    for at in range(0, max(1, len(raw) - length + 1), CHUNK - length):
        piece = np.frombuffer(raw, dtype=np.uint8, count=min(CHUNK - 1, len(raw) - at), offset=at)
        if len(piece) < length:
            continue
        h = _hashes(piece)
        width, low = length - K + 1, np.uint64(CHUNK - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(key) // width)
        grid = np.full(rows * width, ~np.uint64(0))
        grid[: len(key)] = key
        grid = grid.reshape(rows, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - width + 1
        at_min = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at_min[1:] != at_min[:-1]) + 1))
        ends = np.append(first[1:], n)
        pos = at_min[first]
        parts.append((h[pos].view(np.int64), pos + at, first + at, ends + at))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _behind() -> np.ndarray:
    """For two residues, how far behind both there are sample positions."""
    steps = np.zeros((PERIOD, PERIOD), dtype=np.int64)
    for r in range(PERIOD):
        for c in range(PERIOD):
            steps[r, c] = next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (c + d) % PERIOD in COVER)
    return steps


BEHIND = _behind()


def _by(keys: list[np.ndarray]) -> np.ndarray:
    """The order by the first key, then the next ones."""
    return np.lexsort(keys[::-1])


def _new(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """In that order, which elements differ from the one before."""
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return new


def _merged(rank: np.ndarray, where: np.ndarray, group: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The order of suffixes of several residues with equal first bytes in each ``group``, by ranks at a distance that suits both of a pair.

    Each residue is sorted by itself; a suffix's place is the number of those
    before it in its own residue and, by search, in all others.
    """
    code = lambda at, step: group[at] << 42 | rank[where[at] + step] << 21 | tail[at]
    residue = where % PERIOD
    classes = {}
    for r in np.unique(residue).tolist():
        at = np.flatnonzero(residue == r)
        classes[r] = at[np.argsort(code(at, BEHIND[r, r]), kind="stable")]
    place = np.empty(len(where), dtype=np.int64)
    for r, at in classes.items():
        place[at] = np.arange(len(at))
        for c, others in classes.items():
            if c != r:
                place[at] += np.searchsorted(code(others, BEHIND[r, c]), code(at, BEHIND[r, c]))
    return np.argsort(place, kind="stable")


def suffix_order(text: np.ndarray, where: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the suffixes at ``where`` sorted by bucket and first ``length`` bytes; ``new`` tells which differ from the one before.

    Equal strings of a bucket must have equal residues; ``text`` ends in 64
    bytes that no string touches.
    """
    word = np.ndarray((len(text) - 7,), dtype=">u8", buffer=text, strides=(1,))
    read = lambda at: word[at].astype(np.uint64)
    # The sample: what lies less than a period behind some string's start, by all bytes that are left there.
    near = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(near, where, 1)
    np.add.at(near, where + PERIOD, -1)
    sample = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    sample = sample[np.isin(sample % PERIOD, COVER)]
    depth = length - PERIOD + 1
    keys = [read(sample + o) for o in sorted({*range(0, depth - 7, 8), depth - 8})]
    order = _by(keys)
    rank = np.zeros(len(text), dtype=np.int64)
    rank[sample[order]] = np.cumsum(_new(keys, order))
    # First bytes, sample rank by residue, last bytes: 16 each cover what the sample leaves out.
    own = rank[where + np.diag(BEHIND)[where % PERIOD]]
    first, last = [bucket, read(where), read(where + 8)], [read(where + length - 16), read(where + length - 8)]
    whole = [*first, own | (where % PERIOD) << 32, *last]
    order = _by(whole)
    # Ties of several residues are rare, as those of one bucket are aligned; they are merged.
    starts = np.flatnonzero(_new(first, order))
    residue = (where % PERIOD)[order]
    mixed = np.minimum.reduceat(residue, starts) != np.maximum.reduceat(residue, starts)
    if mixed.any():
        sizes = np.diff(np.append(starts, len(order)))
        at = np.flatnonzero(np.repeat(mixed, sizes))
        some = order[at]
        by_tail = _by([x[some] for x in last])
        tail = np.empty(len(some), dtype=np.int64)
        tail[by_tail] = np.cumsum(_new([x[some] for x in last], by_tail))
        group = np.repeat(np.cumsum(mixed) - 1, sizes)[at]
        order[at] = some[_merged(rank, where[some], group, tail)]
    return order, _new(whole, order)


def repeated_starts(pieces: list[tuple[bytes, int, tuple, int]], length: int) -> list[np.ndarray]:
    """For each piece, which of its strings also start in an earlier piece.

    A piece is (bytes, offset of its anchor, order, bucket); it has len - length
    + 1 strings.  The array tells for each whether an equal string stands in a
    piece of smaller order; such pieces share the bucket and the string's place
    relative to the anchor.  Anchors lie on multiples of the period.
    """
    pads = [-a % PERIOD for _, a, _, _ in pieces]
    room = [-(-(p + len(b)) // PERIOD) * PERIOD for p, (b, _, _, _) in zip(pads, pieces, strict=True)]
    begin = np.cumsum([0, *room[:-1]]) + pads
    text = np.zeros(sum(room) + 64, dtype=np.uint8)
    for s, (b, _, _, _) in zip(begin.tolist(), pieces, strict=True):
        text[s : s + len(b)] = np.frombuffer(b, dtype=np.uint8)
    counts = np.array([len(b) - length + 1 for b, _, _, _ in pieces])
    of = np.repeat(np.arange(len(pieces)), counts)
    where = begin[of] + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    order, new = suffix_order(text, where, np.array([p[3] for p in pieces])[of], length)
    turn = np.empty(len(pieces), dtype=np.int64)
    turn[sorted(range(len(pieces)), key=lambda i: pieces[i][2])] = np.arange(len(pieces))
    starts = np.flatnonzero(new)
    turns = turn[of[order]]
    # Equal strings of one piece would have different places, so each turn is there once.
    least = np.repeat(np.minimum.reduceat(turns, starts), np.diff(np.append(starts, len(order))))
    later = np.zeros(len(order), dtype=bool)
    later[order] = turns != least
    return np.split(later, np.cumsum(counts)[:-1])


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    yield from zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """Rows that lack the last columns have nulls there."""
    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds)]
    columns += [pa.nulls(len(rows), t) for _, t in kinds[len(columns) :]]
    return pa.RecordBatch.from_arrays(columns, names=[n for n, _ in kinds])


#: A piece has the strings that start from ``start`` to ``stop``, those whose anchor at ``pos`` is ``low`` to ``high`` (exclusive) bytes behind
#: their start.  A row with ``doc``, ``digest``, ``start`` and ``stop`` only says that those strings also start earlier.
PIECE = [
    ("doc", pa.int64()), ("digest", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("key", pa.int64()), ("pos", pa.int64()),
    ("low", pa.int32()), ("high", pa.int32()), ("bytes", pa.binary()),
]
PIECE_SCHEMA = "doc long, digest long, start long, stop long, key long, pos long, low int, high int, bytes binary"
#: Bits of a run's lead and size; they count starts of one string's length at most.
LEAD = 1 << 14
SIZE = 1 << 14


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text_of()).alias("digest"), text_of().alias("text")
    )


def _anchor_runs(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, doc, digest, mark) of every run; a mark has the anchor's place, how far before it the starts begin, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [anchors(text.as_py().encode(), length) for text in batch.column(2)]
            n = np.array([len(f[0]) for f in found])
            h, pos, begin, end = (np.concatenate([f[k] for f in found]) for k in range(4))
            ids = [np.repeat(batch.column(k).to_numpy(), n) for k in (0, 1)]
            mark = (pos * LEAD + pos - begin) * SIZE + end - begin
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, *ids, mark)], names=["anchor", "doc", "digest", "mark"])

    return texts.mapInArrow(run, "anchor long, doc long, digest long, mark long")


class Collapse:
    """Pieces on their way to an exchange: of equal ones the first is kept, for the others only their place."""

    def __init__(self, held: int) -> None:
        self.most, self.size = held, 0
        self.first: dict[tuple, tuple] = {}
        self.out: list[tuple] = []
        self.gone: list[tuple] = []

    def add(self, piece: tuple) -> None:
        name = (piece[4], piece[5] - piece[2], piece[8])
        was = self.first.get(name)
        if was is None:
            self.first[name] = piece
            self.size += len(piece[8]) + 300
            if self.size > self.most:
                self.out += self.first.values()
                self.first, self.size = {}, 0
        elif was[:3] != piece[:3]:
            if piece[:3] < was[:3]:
                self.first[name], piece = piece, was
            self.gone.append(piece[:4])

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if last:
            self.out += self.first.values()
            self.first, self.size = {}, 0
        for rows in (self.out, self.gone):
            while len(rows) >= (1 if last else 20_000):
                yield _batch(rows[:20_000], PIECE)
                del rows[:20_000]

    def join_gone(self, since: int) -> None:
        """Makes one of those rows from ``since`` on that lie behind each other in one document."""
        rows = self.gone[since:]
        del self.gone[since:]
        rows.sort()
        for r in rows:
            last = self.gone[-1] if len(self.gone) > since else None
            if last and last[:2] == r[:2] and last[3] >= r[2]:
                self.gone[-1] = (*last[:3], max(last[3], r[3]))
            else:
                self.gone.append(r)


def quarters(piece: tuple, length: int) -> Iterator[tuple]:
    """The piece cut by the place of the anchor; each part's key comes from all bytes that its strings share."""
    import xxhash

    doc, digest, start, stop, key, pos, low, high, blob = piece
    step = -(-(high - low) // 4)
    for a in range(low, high, step):
        b = min(high, a + step)
        s, e = max(start, pos - b + 1), min(stop, pos - a + 1)
        if s < e:
            shared = blob[pos - a - start : pos - b + 1 + length - start]
            own = xxhash.xxh3_64_intdigest(shared, a << 8 | b) ^ key & (1 << 64) - 1
            yield doc, digest, s, e, own - (own >> 63 << 64), pos, a, b, blob[s - start : e + length - 1 - start]


def _pieces(marked: DataFrame, length: int, bounds: Bounds) -> DataFrame:
    """Pieces around the marked anchors of (doc, digest, text, marks); the last bit of a mark tells a common anchor."""
    width = length - K + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Collapse(bounds.held)
        for batch in batches:
            ends = batch.column(3).offsets.to_numpy()
            every = batch.column(3).values.to_numpy()
            for i, (doc, digest, text) in enumerate(zip(*(batch.column(k) for k in range(3)), strict=True)):
                raw, doc, digest = text.as_py().encode(), doc.as_py(), digest.as_py()
                marks = every[ends[i] : ends[i + 1]]
                common, marks = marks & 1, marks >> 1
                pos = marks // (LEAD * SIZE)
                start = pos - marks // SIZE % LEAD
                stop = start + marks % SIZE
                key = _hash_at(raw, pos).view(np.int64)
                since = len(found.gone)
                for k, p, s, e, cut in zip(key.tolist(), pos.tolist(), start.tolist(), stop.tolist(), common.tolist(), strict=True):
                    piece = (doc, digest, s, e, k, p, 0, width, raw[s : e + length - 1])
                    if cut:
                        for part in quarters(piece, length):
                            found.add(part)
                    else:
                        found.add(piece)
                found.join_gone(since)
                yield from found.batches()
        yield from found.batches(last=True)

    return marked.select("doc", "digest", "text", "marks").mapInArrow(run, PIECE_SCHEMA)


def _settled(dealt: DataFrame, length: int, bounds: Bounds) -> DataFrame:
    """From pieces dealt and sorted by key: places that go, and the parts of buckets that are too large, as pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        later = Collapse(bounds.held)
        block: list[list[tuple]] = []
        size = 0
        out: list[tuple] = []

        def settle() -> None:
            nonlocal block, size
            pieces = [(p[8], p[5] - p[2], p[:3], n) for n, bucket in enumerate(block) for p in bucket]
            rows = [p for bucket in block for p in bucket]
            for p, flags in zip(rows, repeated_starts(pieces, length) if pieces else (), strict=True):
                out.extend((p[0], p[1], p[2] + a, p[2] + b) for a, b in _runs(flags))
            block, size = [], 0

        key, first, large = None, {}, False

        def close() -> None:
            nonlocal size
            if len(first) > 1:
                block.append(list(first.values()))
                size += sum(len(p[8]) for p in first.values())

        for batch in batches:
            decided = batch.column(8).is_null()
            if decided.true_count:
                yield batch.filter(decided)
                batch = batch.filter(pc.invert(decided))
            for p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p[4] != key:
                    close()
                    key, first, large = p[4], {}, False
                    if size >= bounds.block:
                        settle()
                if large:
                    for part in quarters(p, length):
                        later.add(part)
                    continue
                name = (p[5] - p[2], p[8])
                was = first.get(name)
                if was is None:
                    first[name] = p
                    # Strings of one place only are equal, however many there are.
                    if len(first) > bounds.bucket and p[7] - p[6] > 1:
                        for q in first.values():
                            for part in quarters(q, length):
                                later.add(part)
                        first, large = {}, True
                elif was[:3] != p[:3]:
                    if p[:3] < was[:3]:
                        first[name], p = p, was
                    out.append(p[:4])
            yield from later.batches()
            while len(out) >= 20_000:
                yield _batch(out[:20_000], PIECE)
                out = out[20_000:]
        close()
        settle()
        for at in range(0, len(out), 20_000):
            yield _batch(out[at : at + 20_000], PIECE)
        yield from later.batches(last=True)

    return dealt.mapInArrow(run, PIECE_SCHEMA)


def repeated_ranges(docs: DataFrame, length: int = 100, bounds: Bounds = Bounds()) -> DataFrame:
    """(doc, digest, ranges): byte ranges to remove, possibly overlapping, of each document that has some."""
    if not K + 16 <= length <= LEAD:
        raise ValueError(f"strings have {K + 16} to {LEAD} bytes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = _documents(docs)
    runs = spool(_anchor_runs(texts, length), "runs")
    # A table of its own, so that the join below has plain exchanges and a common anchor can be split there.
    twice = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = spool(twice.select("anchor", (F.col("n") > bounds.common).cast("int").alias("common")), "twice")
    mark = F.col("mark") * 2 + F.col("common")
    marks = spool(runs.join(twice, "anchor").groupBy("doc", "digest").agg(F.collect_list(mark).alias("marks")), "marks")
    unspool(runs)
    unspool(twice)
    pieces = _pieces(texts.join(marks, ["doc", "digest"]), length, bounds)
    gone = []
    while True:
        # What goes anyway isn't dealt by bucket.
        to = F.when(F.col("bytes").isNull(), F.xxhash64("doc", "start")).otherwise(F.col("key"))
        settled = spool(_settled(pieces.repartition(parts, to).sortWithinPartitions("key"), length, bounds), f"settled{len(gone)}")
        if not gone:
            unspool(marks)
        gone.append(settled.where("bytes IS NULL"))
        pieces = settled.where("bytes IS NOT NULL")
        if pieces.isEmpty():
            break
    spans = reduce(DataFrame.union, gone).select("doc", "digest", "start", (F.col("stop") - 1 + length).alias("stop"))
    return spool(spans.groupBy("doc", "digest").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")), "ranges")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "doc_id long, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = 100, bounds: Bounds = Bounds()) -> DataFrame:
    """For every row: doc_id, n_bytes, spans (maximal removed byte runs) and kept (the other bytes)."""
    ranges = repeated_ranges(docs, length, bounds).select(F.col("doc").alias("d"), F.col("digest").alias("g"), "ranges")
    texts = _documents(docs)
    both = texts.join(ranges, (F.col("doc") == F.col("d")) & (F.col("digest") == F.col("g")), "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, gone in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw, doc = text.as_py().encode(), doc.as_py()
                spans = merged([(r["start"], r["stop"]) for r in gone.as_py() or ()])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else raw
                rows.append((None if doc == NULL_ID else doc, len(raw), [{"start": a, "stop": b} for a, b in spans], kept))
            if rows:
                yield _batch(rows, kinds)

    return both.select("doc", "text", "ranges").mapInArrow(run, SPANS)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), length=100)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
