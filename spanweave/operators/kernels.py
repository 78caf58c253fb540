"""Sequential text scanners over one document.  Each yields (start, end) in code points."""

from __future__ import annotations

import ast
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import takewhile

Span = tuple[int, int]
#: Tokens of the document that the characters from a to b touch.
Count = Callable[[int, int], int]
Bounds = Callable[[str], list[int]]

_TOKEN = re.compile(r"[^ \t\n\r]+[ \t\n\r]*|[ \t\n\r]+")


def regex_bounds(text: str) -> list[int]:
    return [0, *(m.end() for m in _TOKEN.finditer(text))]


@lru_cache(maxsize=4)
def _bpe(ranks: str, pattern: str):
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def bpe_ids(text: str, ranks: str, pattern: str) -> list[int]:
    """Token ids; the strings of special tokens are ordinary text."""
    return _bpe(ranks, pattern).encode_ordinary(text)


def bpe_bounds(text: str, ranks: str, pattern: str, misaligned: str = "snap") -> list[int]:
    """Token ends as character offsets; an end within a character maps to that character's index, or is refused with ``error``."""
    import numpy as np

    encoding = _bpe(ranks, pattern)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    ends = np.cumsum([0, *(len(encoding.decode_single_token_bytes(i)) for i in encoding.encode_ordinary(text))])
    # A boundary within a character has counted its lead byte already.
    inside = np.concatenate(((raw & 0xC0) == 0x80, [False]))
    if misaligned == "error" and inside[ends].any():
        raise ValueError("a token ends within a character")
    return (chars[ends] - inside[ends]).tolist()


def counter(ends: list[int]) -> Count:
    """Counts by two searches in the token ends, so no piece is tokenised again."""
    last = len(ends) - 1
    return lambda a, b: min(bisect_left(ends, b), last) - bisect_right(ends, a) + 1 if a < b else 0


def windows(bounds: list[int], most: int, overlap: int) -> Iterator[Span]:
    """Token windows; the last is the first to reach the end; empty ones are left out."""
    most = max(1, most)
    step = most - min(max(0, overlap), most - 1)
    n = len(bounds) - 1
    for i in range(0, max(0, n - most) + step if n else 0, step):
        a, b = bounds[i], bounds[min(n, i + most)]
        if a < b:
            yield a, b


def by_separators(text: str, size: int, overlap: int, separators: list[str]) -> Iterator[Span]:
    """Windows of ``size`` characters, each cut behind the last hit of the first separator it holds."""
    size = max(1, size)
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk")
    named = list(takewhile(bool, separators))  # what stands behind the empty separator never applies
    at, end = 0, len(text)
    while at < end:
        stop = at + size
        if stop >= end:
            yield at, end
            return
        cut = next((k + len(s) for s in named if (k := text.rfind(s, at, stop)) >= 0), stop)
        if cut - at <= overlap:
            cut = stop
        yield at, cut
        at = max(at + 1, cut - overlap)


_LINE = re.compile("[^\n\r\x0b\x0c\x1c-\x1e\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])?")


def line_windows(text: str, most: int, overlap: int, count: Count, start: int = 0, end: int | None = None) -> Iterator[Span]:
    """Whole lines from ``start`` to ``end`` while their tokens fit, one line at least; the next window goes back ``overlap`` lines."""
    most, overlap = max(16, most), max(0, overlap)
    end = len(text) if end is None else end
    ends = [start, *(m.end() for m in _LINE.finditer(text, start, end) if m.end() > m.start())]
    sizes = [count(a, b) for a, b in zip(ends, ends[1:])]
    first = 0
    while first < len(sizes):
        last, held = first + 1, sizes[first]
        while last < len(sizes) and held + sizes[last] <= most:
            held += sizes[last]
            last += 1
        yield ends[first], ends[last]
        if last == len(sizes):
            return
        first = max(first + 1, last - overlap)


#: Boundaries of the budgeted splitter, the strongest first.
_LEVELS = tuple(map(re.compile, (r"\n{2,}", r"\n", r"(?<=[.!?…])\s+", r"(?<=[;:,])\s+", r"\s+")))
_WORD = re.compile(r"\S+\s*")


def budgeted(text: str, most: int, overlap: int, count: Count, start: int = 0, end: int | None = None) -> Iterator[Span]:
    """Pieces of at most ``most`` tokens, cut at the strongest boundaries that allow it; neighbours are joined while they fit."""
    most, end = max(16, most), len(text) if end is None else end

    def split(a: int, b: int, level: int) -> Iterator[Span]:
        if count(a, b) <= most:
            yield a, b
            return
        if level == len(_LEVELS):
            half = (a + b) // 2
            if half in (a, b):
                yield a, b
            else:
                yield from split(a, half, level)
                yield from split(half, b, level)
            return
        edges = [a, *(m.end() for m in _LEVELS[level].finditer(text, a, b) if a < m.end() < b), b]
        if len(edges) == 2:
            yield from split(a, b, level + 1)
            return
        first = a
        for x, y in zip(edges, edges[1:]):
            if first < x and count(first, y) > most:
                yield from split(first, x, level + 1)
                first = x
        yield from split(first, b, level + 1)

    for a, b in split(start, end, 0) if start < end else ():
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if overlap > 0 and a > start and a < b:
            low = a
            for m in reversed(list(_WORD.finditer(text, max(start, a - 16 * overlap), a))):
                if count(m.start(), a) > overlap:
                    break
                low = m.start()
            a = low
        if a < b:
            yield a, b


def python_definitions(text: str) -> list[Span] | None:
    """Top-level functions and classes without decorators; None where there are none or the text isn't Python."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return None
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    chars = lambda row, col: starts[row - 1] + len(lines[row - 1].encode()[:col].decode(errors="ignore"))
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    found = [n for n in tree.body if isinstance(n, kinds) and not n.decorator_list]
    return [(chars(n.lineno, n.col_offset), chars(n.end_lineno, n.end_col_offset)) for n in found] or None


# How models wrap their answers.
_THOUGHT = re.compile(r"(?is)<think>.*?</think>")
_FENCED = re.compile(r"```(?:json)?\s*([\s\S]*?)```")


def first_json(answer: str | None) -> str | None:
    """The first JSON object or array of a model's answer as text; None if there is none."""
    rest = _THOUGHT.sub("", answer or "").strip()
    fenced = _FENCED.search(rest)
    rest = fenced[1].strip() if fenced else rest
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", rest):
        try:
            return rest[m.start() : decoder.raw_decode(rest, m.start())[1]]
        except (ValueError, RecursionError):
            continue
    return None


def proposed_spans(answer: str | None) -> str:
    """The spans that a model's answer proposes, as a JSON array of objects with a, b and t (their own text); items that are none are left out."""
    found = first_json(answer)
    items = json.loads(found) if found else []
    for _ in range(2):
        if isinstance(items, dict):
            items = items.get("chunks", [])
    spans = []
    for x in items if isinstance(items, list) else ():
        try:
            a, b = (int(x.get(long, x.get(short, 0))) for long, short in (("start_offset", "start"), ("end_offset", "end")))
        except (AttributeError, TypeError, ValueError, OverflowError):
            continue
        text = next((x[k] for k in ("text", "chunk_text", "content") if x.get(k)), "")
        low, high = -(1 << 31), (1 << 31) - 1
        spans.append({"a": min(max(a, low), high), "b": min(max(b, low), high), "t": text if isinstance(text, str) else ""})
    return json.dumps(spans)
