"""Line dedup by range-partitioned hashes and keep bitmaps (operator 5), in DataFrame functions only.

Line keys are hashed to 128 bits.  The records (hash, document, place) are
range-partitioned and sorted by hash, then document and place, so the lines of
one frequent key spread over as many partitions as they need.  A stream over
the sorted records marks each document's first occurrence of a key; only those
count as documents.  Lines of frequent keys come back as a sparse bitmap for
each document, never as text.

Defined results: a null or empty text is one empty line and keeps it; empty
keys are never dropped; a document is a pair of id and text, so identical
repeated rows count once and get the same result, and null ids are no problem;
an empty table gives an empty result.  Other columns of the input are kept by
``dedup_lines`` and never used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, ascii_lower, free_name, spool, table, text_of, unspool

#: Lines a bitmap word covers.
WORD = 64
KEY = ("h1", "h2", "doc", "digest")


def _digest() -> Column:
    return F.xxhash64(text_of())


def line_records(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, doc, digest, pos) for each line with a key of at least ``min_chars`` code points."""
    lines = docs.select(
        F.col("doc_id").alias("doc"), _digest().alias("digest"), F.posexplode(F.split(ascii_lower(text_of()), "\n"))
    )
    keyed = lines.select("doc", "digest", "pos", F.btrim("col", F.lit(SPACES)).alias("key")).where(F.length("key") >= min_chars)
    # The seed of the second hash is the hash of its first argument.
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc", "digest", "pos")


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc, digest, words): which lines each document loses.

    ``words`` is an array of (word, bits) by word; bit i of a word stands for
    line 64 * word + i.  Words without a dropped line are left out, and
    documents without one have no row; the keep bitmap is the complement.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The bounds of the ranges come from a sample of the rows; from a table, that doesn't extract them twice.
    keys = spool(line_records(docs, min_chars), "keys")
    ranged = keys.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY, "pos")
    # The range partitioning and the sort meet what the window asks for: no further exchange.
    streamed = ranged.withColumn("first", F.row_number().over(Window.partitionBy(*KEY).orderBy("pos")) == 1)
    records = spool(streamed, "lines")
    unspool(keys)
    frequent = (
        records.where("first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    )
    # As a table of its own it is broadcast if small by its size; else both sides are plain exchanges, which can be split.
    frequent = spool(frequent.select("h1", "h2"), "frequent")
    lost = records.select(*KEY, "pos").join(frequent, ["h1", "h2"])
    words = lost.groupBy("doc", "digest", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % WORD)).alias("bits")
    )
    return words.groupBy("doc", "digest").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def kept_lines(lines: Column, words: Column) -> Column:
    """The lines whose bit isn't set; ``words`` as ``drop_bitmaps`` gives them, or null."""
    dense = F.flatten(
        F.transform(
            words,
            lambda x, k: F.concat(
                F.array_repeat(F.lit(0).cast("long"), x["word"] - F.coalesce(F.get(words, k - 1)["word"], F.lit(-1)) - 1),
                F.array(x["bits"]),
            ),
        )
    )
    held = F.transform(F.array(dense), lambda bits: F.filter(lines, lambda _, i: _unset(bits, i)))[0]
    return F.when(words.isNull(), lines).otherwise(held)


def _unset(bits: Column, i: Column) -> Column:
    word = F.coalesce(F.get(bits, F.floor(i / WORD).cast("int")), F.lit(0).cast("long"))
    return F.getbit(word, (i % WORD).cast("int")) == 0


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, counts: tuple[str, str] = ("_lines", "_lost")) -> DataFrame:
    """Every column of ``docs``, with ``text`` after the loss of frequent lines, and ``counts``: the lines it had and those it lost.

    ``text`` of a document that loses nothing stays as it is, null included;
    columns of ``docs`` with the names of ``counts`` are replaced.
    """
    marks = drop_bitmaps(docs, min_docs, min_chars)
    # The caller's columns travel as one struct, so no name of theirs can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row_"), _digest().alias("its"))
    both = rows.join(marks, F.col("_row_.doc_id").eqNullSafe(F.col("doc")) & (F.col("its") == F.col("digest")), "left")
    both = both.select("_row_", "words", F.split(text_of("_row_.text"), "\n").alias("lines"))
    both = both.withColumn("kept", kept_lines(F.col("lines"), F.col("words")))
    text = F.when(F.col("words").isNull(), F.col("_row_.text")).otherwise(F.array_join("kept", "\n"))
    return both.select(
        *((text if c == "text" else F.col(f"_row_.`{c}`")).alias(c) for c in docs.columns if c not in counts),
        F.size("lines").cast("long").alias(counts[0]),
        (F.size("lines") - F.size("kept")).cast("long").alias(counts[1]),
    )


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The columns of ``docs`` and no others, with ``text`` after the loss of frequent lines."""
    counts = free_name("_lines", docs.columns), free_name("_lost", docs.columns)
    return dedup_lines(docs, min_docs, min_chars, counts).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_chars=1).select(
        "doc_id",
        F.col("_lines").alias("n_lines"),
        F.col("_lost").alias("n_dropped"),
        F.sha2(text_of(), 256).alias("kept_sha256"),
    )
