"""Chunking of a whole table with a whole grid of configurations in one plan.

A chunk row is (config_id, doc_id, chunk_idx, start_offset, end_offset, text,
tokens, lo, hi): offsets in code points, ``lo``/``hi`` the range of document
tokens that the chunk touches.  One Arrow pass reads each document once, finds
its token ends once, and yields the chunks of every configuration, so cost is
linear in the text and no row carries more than its own chunk.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Mapping
from functools import partial
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.arrays import let, offsets
from ..schema import Config
from . import kernels

COLUMNS = ["config_id", "doc_id", "chunk_idx", "start_offset", "end_offset", "text", "tokens", "lo", "hi"]
# Markers of pages, regions and sections.
HEADING = r"(?md)(?=^#{1,3}[ \t]+\S)"
_PAGE = re.compile(r"(?m)^##[ \t]*Page[ \t]+[0-9]+[ \t]*$")
_SECTION = re.compile(r"(?m)^#{1,2}[ \t]+[^ \t\n\x0b\f\r]")
_HEADS = re.compile(r"(?m)^#{1,3}[ \t]+\S")
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
#: Strategies whose token windows are plain fixed ones, and the parameter with their size.
WINDOWED = {"fixed_tokens": ("max_tokens", 512, 1), "late_chunking": ("chunk_size_tokens", 256, 16)}
#: What a strategy of the caller's own does: (text, parameters, token ends) to spans in code points.
Kernel = Callable[[str, Mapping[str, Any], list[int]], Iterator[kernels.Span]]


#: Bytes, by the planner's estimate, below which a table is dealt to all cores before much work on each row.
SMALL = 1 << 30


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt to all cores if they are few: a small file may be one task, and moving it costs next to nothing.

    Larger tables stay as they are read, without an exchange.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size < SMALL else rows


def _window(config: Config) -> tuple[int, int]:
    """(tokens, step) that the configuration comes to."""
    key, default, least = WINDOWED[config.strategy]
    most = max(least, int(config.params.get(key, config.params.get("max_tokens", default))))
    return most, most - min(max(0, int(config.params.get("overlap_tokens", 0))), most - 1)


def parts(text: Column, marker: str) -> Column:
    """Pieces that start at each hit of a lookahead, as (start, text)."""
    pieces = F.split(text, marker)
    return let(
        pieces,
        lambda p: let(
            offsets(F.transform(p, lambda x: F.length(x))),
            lambda o: F.transform(p, lambda x, i: F.struct(F.get(o, i).cast("int").alias("start"), x.alias("text"))),
        ),
    )


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_idx, start_offset, end_offset): markdown sections that aren't blank."""
    rows = docs.select("doc_id", F.posexplode(parts(F.col("content"), HEADING)).alias("i", "s"))
    rows = rows.where(F.col("s.text").rlike(r"[^ \t\n\r]"))
    return rows.select(
        "doc_id", F.col("i").alias("section_idx"), F.col("s.start").alias("start_offset"), (F.col("s.start") + F.length("s.text")).alias("end_offset")
    )


def _regions(text: str, most: int) -> Iterator[kernels.Span]:
    """Pages where there are page headings, else sections of the first two levels, cut every ``most`` characters."""
    if most < 1:
        raise ValueError("max_region_chars must be positive")
    marks = _PAGE if _PAGE.search(text) else _SECTION
    edges = sorted({0, *(m.start() for m in marks.finditer(text)), len(text)})
    for a, b in zip(edges, edges[1:]):
        for at in range(a, b, most):
            yield at, min(b, at + most)


def _spans(config: Config, text: str, ends: list[int], bounds: kernels.Bounds) -> Iterator[kernels.Span]:
    p, count = config.params, kernels.counter(ends)
    overlap, most = int(p.get("overlap_tokens", 0)), int(p.get("max_tokens", 512))
    match config.strategy:
        case "recursive_character" | "agentic":
            size, lap = (1200, 100) if config.strategy == "agentic" else (1600, 0)
            size, lap = int(p.get("chunk_size_chars", size)), int(p.get("chunk_overlap_chars", lap))
            yield from kernels.by_separators(text, size, lap, p.get("separators", SEPARATORS))
        case "semantic":
            yield from kernels.budgeted(text, most, overlap or int(most * float(p.get("similarity_threshold", 0))), count)
        case "markdown_semantic":
            edges = sorted({0, *(m.start() for m in _HEADS.finditer(text)), len(text)})
            for a, b in zip(edges, edges[1:]):
                yield from kernels.budgeted(text, most, overlap, count, a, b)
        case "pdf_structural":
            yield from _regions(text, int(p.get("max_region_chars", 4000)))
        case "structural_semantic":
            for a, b in _regions(text, int(p.get("max_region_chars", 8000))):
                for x, y in kernels.windows(bounds(text[a:b]), max(32, most), overlap):
                    yield a + x, a + y
        case "code_window":
            yield from kernels.line_windows(text, most, int(p.get("overlap_lines", 2)), count)
        case "code_ast":
            found = kernels.python_definitions(text)
            if not found:
                yield from kernels.line_windows(text, most, int(p.get("overlap_lines", 2)), count)
            for a, b in found or ():
                if count(a, b) <= most:
                    yield a, b
                else:
                    yield from kernels.line_windows(text, most, 2, count, a, b)
        case "fixed_tokens" | "late_chunking":
            most, step = _window(config)
            yield from kernels.windows(ends, most, most - step)
        case _:
            raise KeyError(config.strategy)


BUILT_IN = frozenset(
    "fixed_tokens recursive_character semantic markdown_semantic pdf_structural structural_semantic late_chunking code_ast code_window agentic".split()
)


def pieces(
    config: Config,
    text: str,
    ends: list[int],
    bounds: kernels.Bounds = kernels.regex_bounds,
    own: Mapping[str, Kernel] | None = None,
    recorded: list[tuple[int, int]] | None = None,
) -> Iterator[tuple[int, int, str, int, int, int]]:
    """(start, end, text, tokens, lo, hi) of each chunk of one document; ``recorded`` spans stand for those of ``agentic``."""
    if own and config.strategy in own:
        found = own[config.strategy](text, config.params, ends)
    elif recorded and config.strategy == "agentic":
        found = iter(recorded)
    else:
        found = _spans(config, text, ends, bounds)
    last = len(ends) - 1
    for a, b in found:
        if not 0 <= a < b <= len(text):
            raise ValueError(f"{config.id}: span {a} to {b} in a text of {len(text)}")
        piece = text[a:b]
        lo, hi = bisect_right(ends, a) - 1, min(bisect_left(ends, b), last)
        # A piece has a part of each token of the regex tokenizer that it touches, and each part is one token.
        yield a, b, piece, hi - lo if bounds is kernels.regex_bounds else len(bounds(piece)) - 1, lo, hi


def by_kernel(
    docs: DataFrame,
    configs: list[Config],
    bounds: kernels.Bounds = kernels.regex_bounds,
    own: Mapping[str, Kernel] | None = None,
    errors: bool = False,
) -> DataFrame:
    """Every configuration in one Arrow pass; rows leave in batches, so a long text times a large grid stays small in memory.

    ``docs`` may have ``spans``, recorded ones of ``agentic``.  With ``errors`` a
    configuration that fails on a document gives a row with nothing but
    ``error`` there, and all others go on; without, the job fails.
    """
    doc_type = docs.schema["doc_id"].dataType
    with_spans = "spans" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(0).type
            rows: list[tuple] = []
            size = 0
            spans = batch.column(2).to_pylist() if with_spans else [None] * batch.num_rows
            for doc, text, known in zip(batch.column(0).to_pylist(), batch.column(1), spans, strict=True):
                text = text.as_py() or ""
                ends = bounds(text)
                recorded = [(s["a"], s["b"]) for s in known or ()]
                for config in configs if text else ():
                    first = len(rows)
                    try:
                        for i, piece in enumerate(pieces(config, text, ends, bounds, own, recorded)):
                            rows.append((config.id, doc, i, *piece, None))
                            size += len(piece[2])
                    except Exception as e:
                        if not errors:
                            raise
                        del rows[first:]
                        rows.append((config.id, doc, *[None] * 7, f"{type(e).__name__}: {e}"))
                    if size > 4_000_000:
                        yield _chunk_batch(rows, kind, errors)
                        rows, size = [], 0
            if rows:
                yield _chunk_batch(rows, kind, errors)

    n, s = IntegerType(), StringType()
    names = COLUMNS + ["error"] * errors
    schema = StructType([StructField(c, t) for c, t in zip(names, [s, doc_type, n, n, n, s, n, n, n, s])])
    return spread(docs.select("doc_id", "content", *["spans"] * with_spans)).mapInArrow(run, schema)


def _chunk_batch(rows: list[tuple], doc_type: pa.DataType, errors: bool) -> pa.RecordBatch:
    n, s = pa.int32(), pa.string()
    kinds, names = [s, doc_type, n, n, n, s, n, n, n, s], [*COLUMNS, "error"]
    most = len(names) if errors else len(COLUMNS)
    columns = list(zip(*rows, strict=True))[:most]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names[:most])


def with_spans(docs: DataFrame, recorded: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: those of (doc_id, i, start_offset, end_offset) in the order of ``i``, null where there are none."""
    span = F.struct("i", F.col("start_offset").alias("a"), F.col("end_offset").alias("b"))
    held = recorded.groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return docs.join(held, "doc_id", "left")


def chunk(
    docs: DataFrame,
    configs: list[Config],
    ranks: str | None = None,
    pattern: str | None = None,
    own: Mapping[str, Kernel] | None = None,
    recorded: DataFrame | None = None,
    errors: bool = False,
    misaligned: str = "snap",
) -> DataFrame:
    """Chunks of ``docs`` (doc_id, content) for every configuration.

    ``ranks`` and ``pattern`` choose a BPE tokenizer, and ``misaligned`` what
    becomes of token ends within a character: ``snap`` or ``error``.  ``own``
    has the kernels of the caller's own strategies, ``recorded`` the spans that
    a model proposed for ``agentic``.
    """
    for c in configs:
        if c.strategy not in BUILT_IN and c.strategy not in (own or {}):
            raise KeyError(f"{c.strategy} has no kernel")
        if int(c.params.get("max_region_chars", 1)) < 1:
            raise ValueError("max_region_chars must be positive")
    bounds = partial(kernels.bpe_bounds, ranks=ranks, pattern=pattern, misaligned=misaligned) if ranks else kernels.regex_bounds
    rows = docs.select("doc_id", "content")
    return by_kernel(with_spans(rows, recorded) if recorded is not None else rows, configs, bounds, own, errors)


def violations(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks whose offsets are out of bounds or whose text isn't what the document holds there."""
    both = chunks.join(docs.select("doc_id", "content"), "doc_id")
    a, b = F.col("start_offset"), F.col("end_offset")
    wrong = (a < 0) | (a >= b) | (b > F.length("content")) | (F.substring("content", a + 1, b - a) != F.col("text"))
    return both.where(wrong).select("config_id", "doc_id", "chunk_idx", "start_offset", "end_offset")


def sampled(chunks: DataFrame, seed: int = 42) -> DataFrame:
    """All chunks if there are 500 at most, else a tenth of them, 50 to 200, in an order that the seed fixes; the sample is the feature."""
    n = chunks.count()
    if n <= 500:
        return chunks
    order = F.xxhash64(F.lit(seed), "config_id", "doc_id", "chunk_idx")
    return chunks.orderBy(order, "config_id", "doc_id", "chunk_idx").limit(min(200, max(50, n // 10)))
