"""Evaluation datasets from documents: (query_id, doc_id, question, answer_spans, reference_answer)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import token_f1
from . import kernels
from .chunkers import spread
from .embed import by_slices, slices_of

FIELDS = ["query_id", "doc_id", "question", "answer_spans", "reference_answer"]


def _span(a: Column, b: Column) -> Column:
    return F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))


def shuffled(docs: DataFrame, seed: int, most: int) -> DataFrame:
    """The first ``most`` documents in an order that the seed fixes, the same on every run."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), "doc_id"), 256)
    return docs.withColumn("_order", order).orderBy("_order", "doc_id").limit(most).drop("_order")


def first_questions(queries: DataFrame, per_doc: int, most: int) -> DataFrame:
    """At most ``per_doc`` questions a document and ``most`` in all, by document and question id."""
    from pyspark.sql.window import Window

    numbered = queries.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("query_id")))
    return numbered.where(F.col("_n") <= per_doc).orderBy("doc_id", "query_id").limit(most).drop("_n")


def _place(part: Column, text: Column) -> Column:
    """Where ``part`` begins, from 1; 0 if nowhere."""
    return F.call_function("locate", part, text)


def trivial(docs: DataFrame, chars: int = 200) -> DataFrame:
    """One question a document, answered by its start; an empty one gets (0, 1) and is skipped later."""
    end = F.greatest(F.least(F.length("content"), F.lit(chars)), F.lit(1))
    return docs.select(
        F.concat(F.lit("q_"), F.col("doc_id")).alias("query_id"),
        "doc_id",
        F.lit("What information appears at the start of this document?").alias("question"),
        _span(F.lit(0), end).alias("answer_spans"),
        F.lit(None).cast("string").alias("reference_answer"),
    )


def anchored(docs: DataFrame, anchors: list[tuple[str, str, str]], before: int = 50, after: int = 100) -> DataFrame:
    """A question for the first hit, in any case, of each anchor (key, phrase, question); the anchors are a literal array."""
    literal = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(p.lower()).alias("phrase"), F.lit(q).alias("question")) for k, p, q in anchors))
    rows = docs.select("doc_id", "content", F.lower("content").alias("low"), F.explode(literal).alias("x"))
    at = _place(F.col("x.phrase"), F.col("low")) - 1
    rows = rows.withColumn("at", at).where("at >= 0")
    start = F.greatest(F.lit(0), F.col("at") - before)
    end = F.least(F.length("content"), F.col("at") + F.length("x.phrase") + after)
    rows = rows.withColumn("start", start).withColumn("end", end)
    gold = F.trim(F.substring("content", F.col("start") + 1, F.col("end") - F.col("start")))
    return rows.select(
        F.concat_ws("_", F.lit("q"), "doc_id", "x.key").alias("query_id"), "doc_id", "x.question", _span(F.col("start"), F.col("end")).alias("answer_spans"),
        F.when(gold != "", gold).alias("reference_answer"),
    )


def anchored_or_trivial(docs: DataFrame, anchors: list[tuple[str, str, str]], before: int = 50, after: int = 100) -> DataFrame:
    """``anchored``, or ``trivial`` if no document has any of the phrases."""
    found = anchored(docs, anchors, before, after)
    return trivial(docs) if found.isEmpty() else found


def chosen(proposed: DataFrame | None, heuristic: DataFrame, least: int = 10) -> DataFrame:
    """Questions that a model proposed if there are ``least`` of them, else the heuristic ones."""
    return heuristic if proposed is None or proposed.limit(least).count() < least else proposed


def prompts(docs: DataFrame, most: int = 50_000) -> DataFrame:
    """(doc_id, prompt, truncated): the part of each document that a model is asked about; the limit is part of the feature."""
    return docs.select("doc_id", F.left("content", F.lit(most)).alias("prompt"), (F.length("content") > most).alias("truncated"))


#: Bytes by which phrases are looked up; shorter ones are searched one by one.
GRAM = 16


def _gram_keys(raw: bytes) -> np.ndarray:
    """A number for each ``GRAM`` bytes of ``raw``."""
    if len(raw) < GRAM:
        return np.zeros(0, dtype=np.uint64)
    word = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    with np.errstate(over="ignore"):
        key = word[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ (word[8:] + np.uint64(0x7F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        return (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


class PhraseIndex:
    """Phrases by one gram each, that with the smallest key, so phrases that begin alike don't meet."""

    def __init__(self, phrases: list[tuple[Any, str]]) -> None:
        self.short: list[tuple[Any, bytes]] = []
        self.by_key: dict[int, list[tuple[Any, int, bytes]]] = {}
        for item, phrase in phrases:
            raw = phrase.encode()
            keys = _gram_keys(raw)
            if len(keys):
                at = int(keys.argmin())
                self.by_key.setdefault(int(keys[at]), []).append((item, at, raw))
            else:
                self.short.append((item, raw))
        self.keys = np.sort(np.fromiter(self.by_key, dtype=np.uint64, count=len(self.by_key)))

    def first_hits(self, text: str) -> Iterator[tuple[Any, int, int]]:
        """(item, start, end) of the first hit of each phrase, in code points."""
        raw, found = text.encode(), {}
        keys = _gram_keys(raw)
        if len(keys) and len(self.keys):
            near = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)]
            for at in np.flatnonzero(near == keys).tolist():
                for item, offset, phrase in self.by_key[int(keys[at])]:
                    if item not in found and at >= offset and raw.startswith(phrase, at - offset):
                        found[item] = at - offset, phrase
        for item, phrase in self.short:
            at = raw.find(phrase)
            if at >= 0:
                found[item] = at, phrase
        for item, (at, phrase) in found.items():
            start = len(raw[:at].decode())
            yield item, start, start + len(phrase.decode())


def phrase_hits(docs: DataFrame, phrases: DataFrame, most: int = 100_000) -> DataFrame:
    """(item_id, doc_id, start_offset, end_offset) of the first hit of each phrase (item_id, phrase) in each document.

    An index of the phrases is sent to every task, and each document is read
    once against all of them.  A set of more than ``most`` phrases or ``SENT``
    bytes goes by slices, one after the other, each cut off by a checkpoint.
    """
    spark = docs.sparkSession
    known = phrases.select("item_id", "phrase").where("phrase IS NOT NULL").dropDuplicates(["item_id", "phrase"])
    item_type, doc_type = phrases.schema["item_id"].dataType, docs.schema["doc_id"].dataType
    schema = StructType([StructField("item_id", item_type), StructField("doc_id", doc_type), StructField("start_offset", IntegerType()), StructField("end_offset", IntegerType())])
    texts = spread(docs.select("doc_id", F.coalesce("content", F.lit("")).alias("content")))

    def searched(some: list[Row]) -> tuple[DataFrame, Any]:
        sent = spark.sparkContext.broadcast([(r["item_id"], r["phrase"]) for r in some])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, kind = PhraseIndex(sent.value), to_arrow_type(item_type)
            for batch in batches:
                rows = [(item, doc, a, b) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for item, a, b in index.first_hits(text.as_py())]
                if rows:
                    kinds = [kind, batch.schema.field(0).type, pa.int32(), pa.int32()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "start_offset", "end_offset"])

        return texts.mapInArrow(run, schema), sent

    return by_slices(known, ["item_id", "phrase"], slices_of(known, F.octet_length("phrase"), most), searched)


def first_functions(docs: DataFrame, most: int | None = 40) -> DataFrame:
    """The first top-level function of each code document; ``most`` is part of the feature."""
    head = F.regexp_extract("content", r"(?md)^def[ \t]+\w+[ \t]*\(", 0)
    rows = docs.where(F.col("content_type") == "code").withColumn("head", head).where("head <> ''")
    at = F.when(F.startswith("content", "head"), F.lit(0)).otherwise(_place(F.concat(F.lit("\n"), F.col("head")), F.col("content")))
    rows = rows.withColumn("at", at)
    found = rows.select(
        F.concat(F.lit("code_"), F.col("doc_id")).alias("query_id"),
        "doc_id",
        F.lit("What does the first top-level function in this file do?").alias("question"),
        _span(F.col("at"), F.least(F.length("content"), F.col("at") + 400)).alias("answer_spans"),
        F.lit(None).cast("string").alias("reference_answer"),
    )
    return found if most is None else found.orderBy("doc_id").limit(most)


def accepted(proposals: DataFrame, docs: DataFrame, per_doc: int, least_f1: float = 0.85) -> DataFrame:
    """Recorded questions (doc_id, question, a, b, reference_answer) whose span is in range and agrees with the answer."""
    both = proposals.join(docs.select("doc_id", "content"), "doc_id").where(F.col("i") < per_doc)
    inside = (F.col("a") >= 0) & (F.col("a") < F.col("b")) & (F.col("b") <= F.length("content"))
    both = both.where(inside & (F.trim("question") != ""))
    span = F.substring("content", F.col("a") + 1, F.col("b") - F.col("a"))
    ref = F.coalesce(F.col("reference_answer"), F.lit(""))
    return both.where((ref == "") | (token_f1(span, ref) >= least_f1))


def proposed_spans(response: Column) -> Column:
    """The items of a model's answer, in whatever shape they stand: think blocks go, a fenced block is taken alone, then what parses from the first bracket on."""

    def items(texts: pd.Series) -> pd.Series:
        return pd.Series([kernels.proposed_spans(t) for t in texts], dtype=object)

    items.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.from_json(F.pandas_udf(items, "string")(response), "array<struct<a:int,b:int,t:string>>")


def parsed_spans(responses: DataFrame, docs: DataFrame, most: int = 40, prefix: int | None = 50_000) -> DataFrame:
    """(doc_id, i, start_offset, end_offset) from recorded answers of a model: clamped to its prompt, not blank, agreeing with their own text.

    The prompt is the first ``prefix`` characters, as ``prompts`` has it, or the whole document for None.

    Items stand in ``chunks``, in ``chunks.chunks`` or alone as an array; their
    offsets are called start_offset and end_offset or start and end, their text
    text, chunk_text or content.  Answers without JSON have no items.
    """
    from ..functions.text import token_jaccard_ok

    rows = responses.select("doc_id", F.slice(proposed_spans(F.col("response")), 1, most).alias("items"))
    read = F.col("content") if prefix is None else F.left("content", F.lit(prefix))
    rows = rows.join(docs.select("doc_id", read.alias("content")), "doc_id")
    rows = rows.select("doc_id", "content", F.posexplode("items").alias("i", "x"))
    size = F.length("content")
    rows = rows.withColumn("start_offset", F.greatest(F.lit(0), F.least("x.a", size)))
    rows = rows.withColumn("end_offset", F.greatest(F.col("start_offset"), F.least(F.col("x.b"), size)))
    piece = F.substring("content", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    rows = rows.where(piece.rlike(r"[^ \t\n\r]") & token_jaccard_ok(piece, F.col("x.t"), 0.5))
    return rows.select("doc_id", "i", "start_offset", "end_offset")


def transcripts(turns: DataFrame, prefixed: bool = False, most: int | None = None) -> DataFrame:
    """(doc_id, content): the turns of a conversation in order, ``role: text``, joined by a blank line; empty turns go."""
    said = F.trim(F.coalesce("text", F.lit("")))
    rows = turns.withColumn("said", said).where("said <> ''")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "said"))).alias("turns"))
    body = F.array_join(F.transform("turns", lambda t: F.concat_ws(": ", F.trim(t["role"]), t["said"])), "\n\n")
    if prefixed:
        body = F.concat(F.lit("[conversation "), F.col("conv_id"), F.lit("]\n\n"), body)
    return grouped.select(F.col("conv_id").alias("doc_id"), (F.left(body, F.lit(most)) if most else body).alias("content"))
