"""SimHash near-dedup by segment popcounts (operator 6).

A text's fingerprint has the majority bits of its shingles' XXH64.  Equal
fingerprints are one node.  A fingerprint is embedded as the bit counts of its
16 four-bit segments; two fingerprints at Hamming distance d are at most d
apart there in Manhattan distance.  Two points of a grid at most 2 apart have a
point at most 1 from both, so the range join is an equi-join on the cells at
most 1 away.  Members of a cell are verified by the exact distance.  Where a
cell has many members, the same join takes them again on a finer grid: segments
of two bits, then of one.  On the finest, the embedding is the fingerprint
itself and a cell has at most 65 members, which are all at most 2 bits apart,
so those verified against the first of them join all.

Defined results: null and empty texts have fingerprint zero and link like any
other; a null id takes part and never names a component unless all its ids are
null; repeated rows get equal results; an empty table gives an empty result;
only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import by_merge, lean, spool, table, text_of
from .components import components

SEED = 42
#: Bits of a segment on each grid, the coarsest first.
SEGMENTS = (4, 2, 1)
#: Cells with more members are taken again on the next grid.
MEMBERS = 12
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 16


def _shingle_hashes(text: str, width: int) -> list[int]:
    """Hashes of the shingles, repeats included; the whole text if it is shorter, none if it has no word."""
    import xxhash

    words = text.encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return []
    solid = b" ".join(words)
    if len(words) < width:
        return [xxhash.xxh64_intdigest(solid, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(solid[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)]


def _majority(hashes: list[int]) -> int:
    """The word of the bits set in over half of ``hashes``, as a signed 64-bit number."""
    every = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(every), BLOCK):
        bits = np.unpackbits(every[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(every), bitorder="little").view("<i8")[0])


def fingerprint(text: str, width: int) -> int:
    """SimHash of the text's shingles, as a signed 64-bit number."""
    return _majority(_shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def _cells(fp: Column, segment: int) -> Column:
    """Numbers of the cells at most 1 from the fingerprint's point; digit k is the count of segment k."""
    if segment == 1:
        # The point is the word, a step along a digit is another bit.
        masks = [0, *(1 << k if k < 63 else -(1 << 63) for k in range(64))]
        return F.array(*(fp.bitwiseXOR(F.lit(m).cast("long")) for m in masks))
    counts = [
        F.bit_count(F.shiftrightunsigned(fp, k).bitwiseAND(F.lit((1 << segment) - 1))).cast("long")
        for k in range(0, 64, segment)
    ]
    powers = [(segment + 1) ** k for k in range(len(counts))]
    own = sum((c * F.lit(p) for c, p in zip(counts[1:], powers[1:], strict=True)), counts[0])
    near = [F.when(c < segment, F.lit(p)) for c, p in zip(counts, powers, strict=True)]
    near += [F.when(c > 0, F.lit(-p)) for c, p in zip(counts, powers, strict=True)]
    steps = F.array_compact(F.array(F.lit(0).cast("long"), *(x.cast("long") for x in near)))
    return F.transform(F.array(own), lambda at: F.transform(steps, lambda s: at + s))[0]


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= 2


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that join every two fingerprints at most 2 bits apart, directly or by others so near.

    ``nodes`` has each ``fp`` once.  Two that are near share a cell on every
    grid, so it is enough to find them on the first where that cell has few
    members.
    """
    found = []
    for segment in SEGMENTS:
        cells = nodes.select("fp", F.explode(_cells(F.col("fp"), segment)).alias("cell"))
        if segment == SEGMENTS[-1]:
            stars = cells.groupBy("cell").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
            spokes = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
            found.append(spokes.where((F.col("a") < F.col("b")) & _near(F.col("a"), F.col("b"))))
            break
        shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        met = spool(cells.join(by_merge(shared), "cell"), f"cells{segment}")
        few = met.where(F.col("members") <= MEMBERS).groupBy("cell").agg(F.collect_list("fp").alias("fps"))
        pairs = F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (a < b) & _near(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
        found.append(few.select(F.explode(F.flatten(pairs)).alias("e")).select("e.a", "e.b"))
        nodes = met.where(F.col("members") > MEMBERS).select("fp").distinct()
    return reduce(DataFrame.union, found).distinct()


def _roots(each: DataFrame) -> DataFrame:
    """(fp, root) for each fingerprint of ``each``: equal roots are one component."""
    nodes = spool(each.select("fp").distinct(), "nodes")
    roots = components(links(nodes)).withColumnRenamed("node", "fp")
    return nodes.join(by_merge(roots), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest id reachable over links of at most 2 bits."""
    each = spool(fingerprints(docs, width), "fingerprints")
    named = _roots(each).join(by_merge(each.groupBy("fp").agg(F.min("doc_id").alias("least"))), "fp")
    named = spool(named, "named")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(by_merge(names), "root").select(F.col("fp").alias("its_fp"), "component_id")
    return each.join(by_merge(by_fp), F.col("fp") == F.col("its_fp"), "left").select("doc_id", "fp", "component_id")


#: Blocks with more members are linked over hubs and in tiles, not pair by pair.
BLOCK_PAIRS = 100
#: Rounds in which the heaviest member of each crowded block meets all others, and members on a side of a tile after that.
HUBS = 2
TILE = 256
#: One text in ``SAMPLE`` tells which shingles are common; at most ``COMMON`` of them come last in the order of all.
SAMPLE = 16
COMMON = 1 << 18
#: Near pairs are asked to share one more than this part of the smaller set among the first shingles.
SHARED = 20


def _digested(docs: DataFrame, width: int) -> DataFrame:
    """(node, fp, row): a digest of the text's words in order, its fingerprint, and all columns."""
    rows = docs.select(text_of().alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            nodes = [xxhash.xxh3_128_hexdigest(b" ".join(t.as_py().encode().lower().split())) for t in batch.column(0)]
            found = [fingerprint(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(found, pa.int64()), batch.column(1)], names=["node", "fp", "_row_"])

    return rows.mapInArrow(lean(run), StructType([StructField("node", StringType()), StructField("fp", LongType()), rows.schema["_row_"]]))


def _near_prints(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``texts`` (id, fp) that the range join of fingerprints proposes.

    Texts with one fingerprint meet the first of them, and the first texts of
    linked fingerprints meet, so there are few pairs in groups of any size.
    """
    heads = spool(texts.groupBy("fp").agg(F.min("id").alias("head")), "heads")
    same = texts.join(by_merge(heads), "fp").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    met = links(heads.select("fp"))
    for side in "ab":
        met = met.join(by_merge(heads.select(F.col("fp").alias(side), F.col("head").alias(f"its_{side}"))), side)
    near = met.select(F.least("its_a", "its_b").alias("a"), F.greatest("its_a", "its_b").alias("b"))
    return spool(same.union(near), "near_prints")


def _distinct(text: str, width: int) -> np.ndarray:
    """Hashes of the distinct shingles as signed numbers, sorted."""
    return np.unique(np.array(_shingle_hashes(text, width), dtype="<u8").view("<i8"))


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of (id, text): hashes of the distinct shingles of ``width`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_distinct(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return texts.select("id", "text").mapInArrow(lean(run), StructType([StructField("id", LongType()), StructField("shingles", ArrayType(LongType()))]))


def _common(texts: DataFrame, width: int) -> np.ndarray:
    """Common shingles, the most common last; they only order the search, so a sample of texts will do."""
    some = _shingle_sets(texts.where(F.pmod("id", F.lit(SAMPLE)) == 0), width)
    counts = some.select(F.explode("shingles").alias("key")).groupBy("key").count().where("count > 2")
    return counts.orderBy(F.desc("count"), "key").limit(COMMON).select("key").toArrow().column("key").to_numpy()[::-1]


def _prefixes(texts: DataFrame, width: int, share: Fraction) -> DataFrame:
    """(key, id, size): the first shingles of each set in one order of all shingles, common ones last.

    A set of n shingles has its first n - ceil(share * n) + k, k = 1 + n // SHARED.
    Near sets have at least ceil(share * n) in common, so the k-th of these is
    among the first of both: near pairs share k or more of the rows, for the
    smaller k of the two.
    """
    last = _common(texts, width)
    by = np.argsort(last)
    keys = last[by]

    def firsts(text: str) -> tuple[np.ndarray, int]:
        own = _distinct(text, width)
        size = len(own)
        if not size:
            return own, 0
        if len(keys):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            own = own[np.lexsort((own, np.where(keys[at] == own, by[at] + 1, 0)))]
        least = -(-size * share.numerator // share.denominator)
        return own[: size - least + 1 + size // SHARED], size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [firsts(t.as_py()) for t in batch.column(1)]
            long = [len(k) for k, _ in found]
            if not sum(long):
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([k for k, _ in found])),
                    pa.array(np.repeat(batch.column(0).to_numpy(), long)),
                    pa.array(np.repeat([n for _, n in found], long), pa.int32()),
                ],
                names=["key", "id", "size"],
            )

    return texts.select("id", "text").mapInArrow(lean(run), "key long, id long, size int")


def _verified(pairs: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """Those of the pairs (a, b) with ``share`` or more of their shingles in common."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("t")), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("s", "t")).cast("long"))
    every = F.size("s") + F.size("t") - F.col("shared")
    return spool(both.where(F.col("shared") * share.denominator >= every * share.numerator).select("a", "b"), "verified")


def _open(crowds: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of ``crowds`` with their roots over ``edges``, without the blocks that are one component."""
    roots = components(edges).withColumnRenamed("node", "id")
    rooted = crowds.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    block = Window.partitionBy("key")
    several = rooted.withColumn("low", F.min("root").over(block)).withColumn("high", F.max("root").over(block))
    return spool(several.where("low < high").drop("low", "high"), "open")


def _tile_edges(share: Fraction) -> Callable[[pa.Table], pa.Table]:
    """Edges between the rows and the columns of a tile that join what its roots don't yet."""

    def run(tile: pa.Table) -> pa.Table:
        column = tile.column("side").to_numpy() == 1
        rows, cols = tile.filter(pa.array(~column)).combine_chunks(), tile.filter(pa.array(column)).combine_chunks()
        found: list[tuple[int, int]] = []
        if rows.num_rows and cols.num_rows:
            lists = cols.column("shingles").to_pylist()
            size = np.array([len(x) for x in lists])
            owner = np.repeat(np.arange(len(lists)), size)
            every, codes = np.unique(np.concatenate([np.array(x, dtype="<i8") for x in lists]), return_inverse=True)
            ids, root = cols.column("id").to_numpy(), cols.column("root").to_numpy().copy()
            above: dict[int, int] = {}
            for one, own, shingles in zip(rows.column("id").to_pylist(), rows.column("root").to_pylist(), rows.column("shingles").to_pylist(), strict=True):
                while own in above:
                    own = above[own]
                mark = np.zeros(len(every), dtype=bool)
                mine = np.array(shingles, dtype="<i8")
                at = np.minimum(np.searchsorted(every, mine), len(every) - 1)
                mark[at[every[at] == mine]] = True
                shared = np.bincount(owner[mark[codes]], minlength=len(lists))
                near = shared * share.denominator >= (size + len(mine) - shared) * share.numerator
                near &= root != own
                for k in np.flatnonzero(near):
                    if root[k] != own:
                        found.append((one, int(ids[k])))
                        above[int(root[k])] = own
                        root[root == root[k]] = own
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _crowd_edges(crowds: DataFrame, edges: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """``edges`` and those that join all near members of each block of ``crowds`` (key, id, size, weight).

    Hubs only save work: a member with many crowded shingles is likely the one
    the others were made from.  Whatever blocks they leave in several components
    is compared whole, the members outside the largest component with all others
    of the block, in tiles that are tasks of their own.
    """
    spent = None
    for _ in range(HUBS):
        rows = _open(crowds, edges)
        if rows.isEmpty():
            return edges
        free = rows if spent is None else rows.join(spent, "id", "left_anti")
        hubs = spool(free.groupBy("key").agg(F.max(F.struct("weight", "id", "root", "size")).alias("hub")), "hubs")
        now = hubs.select(F.col("hub.id").alias("id")).distinct()
        spent = now if spent is None else spent.union(now)
        met = rows.join(hubs, "key").where("root <> hub.root")
        met = met.where(F.least("size", "hub.size") * share.denominator >= F.greatest("size", "hub.size") * share.numerator)
        pairs = met.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()
        edges = edges.union(_verified(pairs, sets, share))
    rows = _open(crowds, edges)
    if rows.isEmpty():
        return edges
    parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("total"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    parts = parts.select("key", F.col("top.root").alias("top"), tiles(F.col("total") - F.col("top.n")).alias("down"), tiles(F.col("total")).alias("across"))
    rows = rows.join(parts, "key")
    dealt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    minor = rows.where("root <> top").select("key", "id", "root", F.lit(0).alias("side"), dealt(F.col("down")).alias("i"), numbers(F.col("across")).alias("j"))
    every = rows.select("key", "id", "root", F.lit(1).alias("side"), numbers(F.col("down")).alias("i"), dealt(F.col("across")).alias("j"))
    whole = minor.unionByName(every).join(sets, "id").groupBy("key", "i", "j")
    return edges.union(spool(whole.applyInArrow(_tile_edges(share), "a long, b long"), "tiles"))


def near_copies(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``texts`` (id, fp, text) with ``similarity`` or more.

    SimHash comes first: pairs that the range join of the fingerprints proposes
    are verified by the exact Jaccard similarity of shingles.  Similar texts may
    have fingerprints far apart, so an exact prefix filter on the rows of
    ``_prefixes`` adds those pairs that are missing.  Those that meet in blocks
    of few members only must meet often enough and are verified in the same way;
    those that meet in a crowded block are left to ``_crowd_edges``, however
    often they meet.
    """
    printed = _near_prints(texts.select("id", "fp"))
    share = Fraction(similarity).limit_denominator(10_000)
    prefixes = _prefixes(texts, width, share)
    blocks = spool(prefixes.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("members > 1"), "blocks")

    def alike(a: Column, b: Column) -> Column:
        sizes = F.least(a["size"], b["size"]) * share.denominator >= F.greatest(a["size"], b["size"]) * share.numerator
        return (a["id"] < b["id"]) & sizes

    def pair(a: Column, b: Column) -> Column:
        least = F.floor(F.least(a["size"], b["size"]) / SHARED) + 1
        return F.struct(a["id"].alias("a"), b["id"].alias("b"), least.alias("least"))

    few = blocks.where(F.col("members") <= BLOCK_PAIRS).groupBy("key").agg(F.collect_list(F.struct("id", "size")).alias("them"))
    pairs = F.flatten(F.transform("them", lambda a: F.transform(F.filter("them", lambda b: alike(a, b)), lambda b: pair(a, b))))
    met = few.select(F.explode(pairs).alias("e")).groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("n"), F.max("e.least").alias("least"))
    candidates = spool(met.where("n >= least").select("a", "b"), "candidates")
    crowded = blocks.where(F.col("members") > BLOCK_PAIRS)
    weights = crowded.groupBy("id").agg(F.sum("members").alias("weight"))
    crowds = spool(crowded.join(weights, "id").select("key", "id", "size", "weight"), "crowds")
    asked = candidates.union(printed).select(F.explode(F.array("a", "b")).alias("id")).union(crowds.select("id")).distinct()
    sets = spool(_shingle_sets(texts.join(asked, "id", "left_semi"), width), "shingles")
    return _crowd_edges(crowds, _verified(printed.union(candidates).distinct(), sets, share), sets, share)


def first_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies, whole: that with the smallest id, null ids last, any one of repeated rows.

    Near copies share at least ``similarity`` of their shingles of ``width``
    words, directly or over others.  SimHash finds what it can, an exact filter
    the rest, so no link is missed.  Rows are written once with a fingerprint
    and a number; winners are found on numbers alone, and only the last join
    moves rows.
    """
    each = spool(_digested(docs, width).withColumn("number", F.monotonically_increasing_id()), "numbered")
    ident = F.col("_row_.doc_id").cast("long")
    order = F.struct(ident.isNull().alias("no"), ident.alias("id"), F.col("number").alias("number"))
    nodes = spool(each.groupBy("node").agg(F.min(order).alias("first")).select(F.col("first.number").alias("id"), "first"), "nodes")
    texts = each.select(F.col("number").alias("id"), "fp", text_of("_row_.text").alias("text")).join(nodes.select("id"), "id", "left_semi")
    roots = components(near_copies(texts, width, similarity)).withColumnRenamed("node", "id")
    rooted = nodes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    winners = rooted.groupBy("root").agg(F.min("first").alias("first"))
    kept = each.join(winners.select(F.col("first.number").alias("number")), "number", "left_semi")
    return kept.select(*(F.col(f"_row_.`{c}`").alias(c) for c in docs.columns))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
