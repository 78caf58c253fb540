"""Quality by nearest-neighbour voting (operator 9).

Texts become hashed counts of words and of word forms, weighted by inverse
document frequency, and are projected onto the leading singular directions of a
labelled sample: latent-semantic vectors.  The sample's vectors are broadcast;
every document is compared with all of them by exact cosine, a block of
documents at a time, and its nearest neighbours vote with their similarity as
weight, each class also weighted by its rarity in the sample.

Only fitting uses a sample: at most ``Fit.sample`` labelled texts of each class,
those with the smallest hash of their id, so what is broadcast is bounded
whatever the corpus.  Every document is scored, whole.

Defined results: a null or empty text has no features and gets the score of an
even vote of its (zero) similarities, that is the prior of one half times two
classes, 0.5; without labelled rows of both classes every score is 0.5; repeated
rows get equal scores; neighbours tied with the last one vote too; a null id is
never a training row; an empty table gives an empty result.  Labels are null or
0/1; null ones are left out.  Of the inputs only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_name, lean, table, text_of

#: Documents compared at once.
BLOCK = 512


@dataclass(frozen=True)
class Fit:
    #: Labelled texts of each class that fitting reads at most, and their bytes at most (whole texts or none).
    sample: int = 1500
    sample_bytes: int = 64_000_000
    buckets: int = 1024
    rank: int = 48
    neighbours: int = 15


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # features x rank
    vectors: np.ndarray  # neighbours x rank, of length one
    labels: np.ndarray
    weights: np.ndarray
    fit: Fit


#: Word forms counted beside the words themselves.
FORMS = 16


def features(text: str, buckets: int) -> np.ndarray:
    """Log counts of hashed words, then shares of word forms.  Cost is linear in the text."""
    import zlib

    raw = text.encode()
    words = raw.split()
    out = np.zeros(buckets + FORMS, dtype=np.float32)
    if not words:
        return out
    n = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    at = np.fromiter((zlib.crc32(w) for w in counts), dtype=np.uint32, count=len(counts)) % buckets
    often = np.fromiter(counts.values(), dtype=np.float32, count=len(counts))
    np.add.at(out, at, np.log1p(often))
    out[:buckets] /= max(1.0, float(np.linalg.norm(out[:buckets])))
    byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size = len(raw)
    lengths = np.fromiter(map(len, words), dtype=np.int32, count=n)
    same = sum(a == b for a, b in zip(words, words[1:]))
    form = out[buckets:]
    form[0] = byte[list(b"#*$%&<>^~=")].sum() / n
    form[1] = byte[ord("|")] / n
    form[2] = byte[list(b"!?")].sum() / n
    form[3] = byte[65:91].sum() / size
    form[4] = byte[48:58].sum() / size
    form[5] = len(counts) / n
    form[6] = same / n
    form[7] = byte[list(b".,;:")].sum() / n
    form[8] = min(float(lengths.mean()), 30.0) / 10
    form[9] = min(float(lengths.std()), 30.0) / 10
    form[10] = byte[10] / n
    form[11] = byte[list(b"{}[]()/\\_@")].sum() / n
    form[12] = max(often) / n
    form[13] = byte[128:].sum() / size
    form[14] = float(np.square(often).sum()) / (n * n)
    form[15] = 1.0
    form[:] = np.minimum(form, 3.0)
    return out


def fit_model(texts: list[str], labels: list[int], fit: Fit) -> Model | None:
    """None unless both classes are there."""
    if len(set(labels)) < 2:
        return None
    rows = np.stack([features(t, fit.buckets) for t in texts])
    held = (rows > 0).sum(axis=0)
    idf = (np.log((1 + len(rows)) / (1 + held)) + 1).astype(np.float32)
    # Forms count as much as all words together; each is scaled to unit spread.
    spread = rows[:, fit.buckets :].std(axis=0)
    idf[fit.buckets :] = np.where(spread > 1e-6, 0.5 / np.maximum(spread, 1e-6), 0.0)
    idf[: fit.buckets] *= 0.25
    rows *= idf
    # Singular directions of the sample by its Gram matrix of features.
    values, directions = np.linalg.eigh(rows.T.astype(np.float64) @ rows)
    basis = directions[:, np.argsort(values)[::-1][: fit.rank]].astype(np.float32)
    vectors = rows @ basis
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    y = np.array(labels)
    share = np.bincount(y, minlength=2) / len(y)
    return Model(idf, basis, vectors / np.maximum(norms, 1e-9), y, (0.5 / share)[y], fit)


def vote(model: Model, rows: np.ndarray) -> np.ndarray:
    """Scores of a block of feature rows.

    Cosines count to four places, so equal texts score alike in any block, and
    all neighbours as near as the last one vote.
    """
    vectors = (rows * model.idf) @ model.basis
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    cosine = np.round((vectors @ model.vectors.T).astype(np.float64), 4)
    k = min(model.fit.neighbours, cosine.shape[1])
    last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k][:, None]
    at, near = np.nonzero(cosine >= last)
    weight = np.maximum(cosine[at, near], 0.0) ** 4 * model.weights[near]
    good = np.bincount(at, weight * model.labels[near], len(rows))
    total = np.bincount(at, weight, len(rows))
    return np.where(total > 1e-12, good / np.maximum(total, 1e-12), 0.5)


def train(docs: DataFrame, labelled: DataFrame, label: str, fit: Fit = Fit()) -> Model | None:
    """Fit on rows of ``labelled`` (doc_id, label), joined with their texts."""
    known = labelled.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    samples = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.sample) for y in (0, 1)
    ]
    few = F.broadcast(samples[0].union(samples[1]))  # at most twice Fit.sample rows
    found = docs.select("doc_id", text_of().alias("text")).join(few, "doc_id")
    rows, size = [], 0
    for row in found.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * fit.sample).toLocalIterator():
        size += len(row["text"].encode())
        if size > fit.sample_bytes:
            break
        rows.append((row["text"], row["y"]))
    return fit_model([t for t, _ in rows], [y for _, y in rows], fit)


def score_documents(docs: DataFrame, model: Model | None, into: str = "score") -> DataFrame:
    """Every column of ``docs`` and the score; a column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c != into]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row_"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        for batch in batches:
            texts = batch.column(1)
            scores = np.full(len(texts), 0.5)
            for at in range(0, len(texts), BLOCK) if fitted else ():
                block = np.stack([features(t.as_py(), fitted.fit.buckets) for t in texts[at : at + BLOCK]])
                scores[at : at + BLOCK] = np.where(block.any(axis=1), vote(fitted, block), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["_row_", "score"])

    found = rows.mapInArrow(lean(run), StructType([rows.schema["_row_"], StructField("score", DoubleType())]))
    return found.select(*(F.col(f"_row_.`{c}`").alias(c) for c in own), F.col("score").alias(into))


def keep_good(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with the columns of ``docs`` and no others."""
    score = free_name("_score", docs.columns)
    return score_documents(docs, model, score).where(F.col(score) >= least).select(*(F.col(f"`{c}`") for c in docs.columns))


def is_held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def trained_on(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model | None:
    return train(docs, labels.where(~is_held_out()), "quality", fit)


def op9_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained_on(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
