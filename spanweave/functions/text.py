"""Text functions on columns: normalisation, detection, tokens, token similarity."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..operators.kernels import regex_bounds

#: The lossless regex tokenizer: a word with the white space after it, or leading white space.
TOKEN = r"([^ \t\n\r]+[ \t\n\r]*|[ \t\n\r]+)"

# Extensions and what they hold.
CONTENT_TYPES = {
    "txt": "text", "md": "markdown", "mdx": "markdown", "html": "html", "htm": "html", "pdf": "pdf", "docx": "docx",
    "pptx": "pptx", "py": "code", "js": "code", "ts": "code", "tsx": "code", "go": "code", "java": "code", "rs": "code",
    "cpp": "code", "c": "code",
}
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rs": "rust",
    "cpp": "cpp", "c": "c",
}
#: The file scan knows all but this one.
SCANNED = [x for x in CONTENT_TYPES if x != "tsx"]
REPO_EXTENSIONS = ["py", "js", "ts", "tsx", "go", "java", "rs", "cpp", "c", "md", "txt"]
VENDOR_PARTS = ["node_modules", "__pycache__", ".git", "dist", "build", ".venv", "venv"]
# What a heading is, and elements that go from HTML.
HEADING = r"(?md)^#{1,3}\s+\S"
BOILERPLATE = ("script", "style", "nav", "footer")


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def at_most_two_blank(text: Column) -> Column:
    return F.regexp_replace(text, "\n{4,}", "\n\n\n")


def trim_line_ends(text: Column) -> Column:
    """All Unicode white space before each line end; the lookbehind keeps long runs linear."""
    return F.regexp_replace(text, r"(?mdU)(?<![\s&&[^\n]])[\s&&[^\n]]+$", "")


def trim_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|(?<!\s)\s+\z", "")


def without(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, f"(?m){p}", ""), patterns, text)


def strip_boilerplate(html: Column) -> Column:
    """Script, style, nav and footer elements go, in that order; other tags stay."""
    return reduce(lambda t, tag: F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", ""), BOILERPLATE, html)


def normalize(text: Column, patterns: list[str] | None = None, html: bool = False) -> Column:
    """Newlines, blank runs, line ends, the caller's patterns, HTML boilerplate, both ends."""
    out = without(trim_line_ends(at_most_two_blank(unix_newlines(text))), patterns or [])
    return trim_ends(strip_boilerplate(out) if html else out)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def content_type(path: Column, sample: Column) -> Column:
    by_heading = F.when(sample.rlike(HEADING), "markdown").otherwise("text")
    return F.coalesce(_looked_up(extension(path), CONTENT_TYPES), by_heading)


def language(path: Column) -> Column:
    return _looked_up(extension(path), LANGUAGES)


def is_scanned(path: Column) -> Column:
    return extension(path).isin(SCANNED)


def in_repo_scan(path: Column) -> Column:
    vendor = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDOR_PARTS)))
    return extension(path).isin(REPO_EXTENSIONS) & ~vendor & ~path.endswith(".min.js")


def decoded(raw: Column) -> Column:
    """UTF-8, or Latin-1 where that fails."""
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, "ISO-8859-1"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def token_bounds(text: Column) -> Column:
    """Character offsets of the token ends, 0 first.

    In Arrow batches: without a running sum over arrays, columns alone took three times as long.
    """

    def bounds(texts: pd.Series) -> pd.Series:
        return pd.Series([regex_bounds(t or "") for t in texts], dtype=object)

    bounds.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(bounds, ArrayType(IntegerType()))(text)


def _token_set(text: Column) -> Column:
    return F.array_distinct(F.transform(tokens(text), lambda t: F.regexp_replace(t, r"[ \t\n\r]+$", "")))


def token_jaccard_ok(actual: Column, intended: Column, threshold: float) -> Column:
    """True where token sets overlap enough; a blank ``intended`` is fine with anything."""
    a, b = _token_set(actual), _token_set(intended)
    share = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    blank, empty = trim_ends(intended) == "", (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(blank, True).when(empty, trim_ends(actual) == trim_ends(intended)).otherwise(share >= threshold)


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = _token_set(a), _token_set(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def token_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of shared parts of both token sets; 0 where one is empty."""
    x, y = _token_set(a), _token_set(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(2.0 * both, F.size(x) + F.size(y)), F.lit(0.0))
