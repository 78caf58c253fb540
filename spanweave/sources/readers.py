"""Files, repositories, web pages and query files as documents; all reading is Spark's own."""

from __future__ import annotations

import json
import os
import posixpath
import re
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CONTENT_TYPES, content_type, decoded, extension, in_repo_scan, is_scanned, language, normalize
from .workspace import parse_yaml

#: What a converter has to turn into markdown before it can be read here.
CONVERTED = ("pdf", "docx", "pptx")


def _binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    )


def _documents(files: DataFrame, content: Column, kind: Column, **metadata: Column) -> DataFrame:
    """Ids come from the path, so a rerun gives the same ones."""
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v)]
    return files.select(
        F.sha2("path", 256).alias("doc_id"),
        content.alias("content"),
        kind.alias("content_type"),
        "path",
        F.lit(None).cast("string").alias("source_url"),
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("metadata"),
        F.lit(None).cast("string").alias("group_id"),
        F.lit(None).cast("int").alias("page_number"),
        language(F.col("path")).alias("language"),
    )


def confined(path: str, root: str | None) -> str:
    """``path`` with links and dots resolved; it must be ``root`` or under it."""
    if root is None:
        return path
    scheme = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*")

    def plain(p: str) -> str:
        if scheme.match(p) and not p.startswith("file:"):
            start = scheme.match(p)[0]
            return start + posixpath.normpath(p[len(start) :])
        return os.path.realpath(p.removeprefix("file://").removeprefix("file:"))

    real, base = plain(path if os.path.isabs(path) or scheme.match(path) else os.path.join(root, path)), plain(root)
    if real != base and not real.startswith(base.rstrip("/") + "/"):
        raise PermissionError(f"{path} is not under {root}")
    return real


#: Turns the bytes of a file into markdown.
Converter = Callable[[bytes], str]


def converted(files: DataFrame, converters: Mapping[str, Converter]) -> DataFrame:
    """``files`` (path, content) with ``text`` of those formats that ``converters`` (by extension) takes, and ``error`` where one failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = converters.get(path.rsplit(".", 1)[-1].lower())
                try:
                    texts.append(own(raw.as_py()) if own else None)
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def scan_report(spark: SparkSession, path: str, pattern: str = "*", converters: Mapping[str, Converter] | None = None) -> DataFrame:
    """(path, status, error) of every file: read, converted, no_converter, failed or unsupported; nothing is left out silently."""
    files = _binary(spark, path, pattern)
    kind = extension(F.col("path"))
    tried = converted(files.where(kind.isin(sorted(converters or ()))), converters or {})
    done = tried.select("path", F.when(F.col("error").isNull(), "converted").otherwise("failed").alias("status"), "error")
    rest = files.where(~kind.isin(sorted(converters or ())))
    status = F.when(~is_scanned(F.col("path")), "unsupported").when(kind.isin(*CONVERTED), "no_converter").otherwise("read")
    return rest.select("path", status.alias("status"), F.lit(None).cast("string").alias("error")).unionByName(done)


def read_files(
    spark: SparkSession, path: str, root: str | None = None, pattern: str = "*", kind: str | None = None, converters: Mapping[str, Converter] | None = None
) -> DataFrame:
    """Supported files under ``path``, decoded and normalised.

    ``root`` confines the scan; ``kind`` overrides detection.  pdf, docx and
    pptx files need a converter to markdown each; without one they are expected
    as ``name.pdf.md`` and the like.  Files that can't be converted are left out
    here; ``scan_report`` names them.
    """
    files = _binary(spark, confined(path, root), pattern).where(is_scanned(F.col("path")))
    ext, name = extension(F.col("path")), F.element_at(F.split("path", "/"), -1)
    plain = files.where(~ext.isin(*CONVERTED)).withColumn("text", decoded(F.col("content")))
    inner = F.regexp_extract("path", r"\.(pdf|docx|pptx)\.md$", 1)
    found = F.lit(kind) if kind else F.when(inner != "", inner).otherwise(content_type(F.col("path"), F.col("text")))
    utf8 = F.try_validate_utf8(F.col("content").cast("string")).isNotNull()
    text = F.when(found == "html", normalize(F.col("text"), html=True)).otherwise(normalize(F.col("text")))
    documents = _documents(plain, text, found, filename=name, source_encoding=F.when(~utf8, F.lit("latin-1")))
    formats = sorted(set(CONVERTED).intersection(converters or ()))
    if formats:
        made = converted(files.where(ext.isin(formats)), converters).where("error IS NULL AND text IS NOT NULL")
        other = F.lit(kind) if kind else ext
        documents = documents.unionByName(_documents(made, normalize(F.col("text")), other, filename=name, parser=F.lit("converter")))
    return documents.orderBy("path")


def read_repo(spark: SparkSession, root: str) -> DataFrame:
    """Code and prose of a repository without vendored parts; code keeps its exact text."""
    files = _binary(spark, root)
    base = root.rstrip("/") + "/"
    # The scan may put a scheme before the root as given; what counts is what stands behind its first place.
    rel = F.substring("path", F.call_function("locate", F.lit(base), F.col("path")) + len(base), F.length("path"))
    files = files.withColumn("rel", rel).where(in_repo_scan(F.col("rel"))).withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair)), extension(F.col("path")))
    text = F.when(kind == "code", F.col("text")).otherwise(normalize(F.col("text")))
    return _documents(files, text, kind, repo_root=F.lit(root), rel_path=F.col("rel")).orderBy("path")


def is_public(url: Column) -> Column:
    """Whether a URL is http or https and its host isn't a private, loopback or link-local address by its text; names aren't resolved."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    four = r"(?:10\.|127\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|0\.)[0-9.]*"
    private = rf"^(?:localhost|.*\.localhost|{four}|[0-9]+|0x[0-9a-f.x]+|\[(?:::1?|f[cd][0-9a-f]*:.*|fe[89ab][0-9a-f]:.*|::ffff:{four})\])$"
    return url.rlike(r"^(?i)https?://") & (host != "") & ~host.rlike(private)


def read_pages(pages: DataFrame, kind: str = "content_type") -> DataFrame:
    """Fetched pages (url, html) as documents, those of public http and https addresses only.

    A column ``kind`` with the header of the answer tells html from other text,
    which is kept as markdown; without it all are html.
    """
    rows = pages.where(is_public(F.col("url"))).withColumn("path", F.col("url"))
    is_html = F.coalesce(F.contains(F.lower(kind), F.lit("html")), F.lit(True)) if kind in pages.columns else F.lit(True)
    text = F.when(is_html, normalize(F.col("html"), html=True)).otherwise(F.col("html"))
    found = _documents(rows, text, F.when(is_html, "html").otherwise("markdown"), filename=F.parse_url("url", F.lit("HOST")))
    return found.withColumn("source_url", F.col("path"))


_QUERY = "struct<id:string,question:string,document_id:string,answer_spans:array<array<int>>,reference_answer:string>"


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """A dataset file of JSON or YAML with ``queries``; an id that isn't given comes from the query itself."""
    schema = f"name string, queries array<{_QUERY}>"
    if path.rsplit(".", 1)[-1].lower() in ("yaml", "yml"):
        # One file that a person wrote, so it is read whole and handed on as JSON.
        text = spark.read.text(path, wholetext=True).first()[0]
        rows = spark.createDataFrame([(json.dumps(parse_yaml(text) or {}, default=str),)], "text string").select(F.from_json("text", schema).alias("f")).select("f.*")
    else:
        rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    rows = rows.select("name", F.explode("queries").alias("q"))
    spans = F.transform("q.answer_spans", lambda s: F.struct(s[0].alias("a"), s[1].alias("b")))
    ident = F.coalesce("q.id", F.sha2(F.concat_ws("|", "q.document_id", "q.question"), 256))
    return rows.select(
        F.coalesce("name", F.lit(path.rsplit("/", 1)[-1].rsplit(".", 1)[0])).alias("dataset"), ident.alias("query_id"),
        F.col("q.document_id").alias("doc_id"), "q.question", spans.alias("answer_spans"), "q.reference_answer",
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as (doc_id, content); a null text is empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
