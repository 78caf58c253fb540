"""A training corpus from the documents table, in five stages.

Each stage works on all that the one before kept, written as Parquet in the
shared folder and read again, so a lost executor never costs more than tasks of
the running stage.  All stages but the last return the columns of documents,
with ``n_chars`` following the text; further columns of the input pass through
as they are, whatever their names.

Odd rows in every stage: a null text counts as empty and stays null; a null id
is an id like any other; repeated rows are treated alike; an empty table gives
an empty result; texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import knn_quality, line_dedup, packing, secret_scan, simhash
from spanweave.llm.common import spool, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents scored below this go.
LEAST_SCORE = 0.3
#: Values in each cache of a packing worker. Stages before leave the executor's heap grown, so there is less room than for packing alone.
CACHED = 200_000


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now is; a null text keeps what it had, and a table without that column stays without."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the voting classifier rejects; it is fitted on the training labels of ``docs``.

    Null and empty texts score 0.5 and stay, as do all documents where the
    labels have one class only; a score of just the threshold stays; repeated
    rows go or stay together.
    """
    model = knn_quality.trained_on(docs, table(spark, sf_dir, "labels"))
    return knn_quality.keep_good(docs, model, LEAST_SCORE)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more are gone from all; the documents stay, with an empty text if it was all lines.

    Rows repeated with id and text count as one document; a null text stays
    null; empty lines stay.
    """
    return _measured(line_dedup.drop_frequent_lines(docs, min_docs=10, min_chars=1))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 or more of their five-word shingles in common.

    The smallest id stays, null ids last, any one of repeated rows; texts of
    fewer than five words are copies only if their words are equal, and null
    texts and those without words are copies of each other.
    """
    return simhash.first_of_each(docs, width=5, similarity=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret gives way to its kind in angle brackets; the documents stay, null texts as null."""
    return _measured(secret_scan.mask_secrets(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in its training sequence; a null text is an end token alone, repeated rows are packed once each."""
    import public_tokenizers

    return packing.digests(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), most=CACHED))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_common_lines),
    ("simhash_near_dedup", one_of_each),
    ("secret_scans", without_secrets),
    ("packing", packed),
]

#: SQL expresses neither the classifier nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
