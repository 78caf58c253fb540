"""Embeddings: a deterministic hash embedder, distinct-text embedding, and a Parquet cache."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..schema import Config

#: 32 rounds of SHA-256, 8 numbers each.
ROUNDS = 32
Embedder = Callable[[pd.Series], pd.Series]


def _digests(text: str, seed: int) -> bytes:
    """``ROUNDS`` rounds of SHA-256, from ``seed:text`` on."""
    digest = hashlib.sha256(f"{seed}:{text}".encode()).digest()
    found = [digest]
    for _ in range(ROUNDS - 1):
        digest = hashlib.sha256(digest).digest()
        found.append(digest)
    return b"".join(found)


def hash_embedder(seed: int = 0) -> Embedder:
    """256 numbers of iterated SHA-256 of seed and text, scaled to length one."""

    def embed(texts: pd.Series) -> pd.Series:
        v = np.frombuffer(b"".join([_digests(t, seed) for t in texts]), dtype="<u4").reshape(len(texts), -1) / 2.0**32
        return pd.Series(list(v / (np.sqrt((v * v).sum(axis=1)) + 1e-9)[:, None]), index=texts.index, dtype=object)

    return embed


#: Texts of one call to a provider, tries of a call, and seconds before the second try and at most before a later one.
CALL, TRIES, FIRST_WAIT, LONGEST_WAIT = 64, 4, 4.0, 60.0


def provider_embedder(call: Callable[[list[str]], list[tuple[int, list[float]]]], most: int = CALL, tries: int = TRIES, wait: float = FIRST_WAIT) -> Embedder:
    """An embedder over a provider's ``call``, which takes texts and gives (index, vector) pairs in any order.

    It is asked for at most ``most`` texts at once and again after a failure,
    with a wait that doubles up to a minute; the last failure is raised.
    """

    def once(texts: list[str]) -> list[list[float]]:
        pause = wait
        for left in reversed(range(tries)):
            try:
                found = dict(call(texts))
                return [found[i] for i in range(len(texts))]
            except Exception:
                if not left:
                    raise
                time.sleep(pause)
                pause = min(2 * pause, LONGEST_WAIT)
        raise ValueError("tries must be positive")

    def embed(texts: pd.Series) -> pd.Series:
        every = texts.tolist()
        vectors = [np.asarray(v, dtype=float) for at in range(0, len(every), most) for v in once(every[at : at + most])]
        return pd.Series(vectors, index=texts.index, dtype=object)

    return embed


def embedder_for(model: str | None, call: Callable[[list[str]], list[tuple[int, list[float]]]] | None = None, dummy: bool = False) -> tuple[str, Embedder]:
    """(profile, embedder): the hash embedder if asked for or without a model, else the model's provider, which must be given."""
    if dummy or not model:
        return "hash_v1", hash_embedder(0)
    if call is None:
        raise ValueError(f"no provider is given for {model}")
    return model, provider_embedder(call)


def embed_column(embedder: Embedder, text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return embedder(texts)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, ArrayType(DoubleType()))(text)


def text_key(profile: str, text: Column, role: str = "document") -> Column:
    """The cache key: SHA-256 of model and text; what is embedded as a query has keys of its own."""
    return F.sha2(F.concat(F.lit(f"{profile}|" if role == "document" else f"{profile}|{role}|"), text), 256)


def params_json(params: Column) -> Column:
    """A map of parameters as JSON with sorted keys, equal maps as equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def chunk_key(content: Column, strategy: Column, params: Column) -> Column:
    nul = F.lit("\0")
    return F.sha2(F.concat(content, nul, strategy, nul, params), 256)


def embed_distinct(texts: DataFrame, embedder: Embedder, profile: str = "hash_v1") -> DataFrame:
    """(text_hash, vec) for each distinct ``text``; equal texts are embedded once."""
    keyed = texts.select(text_key(profile, F.col("text")).alias("text_hash"), "text")
    return keyed.dropDuplicates(["text_hash"]).select("text_hash", embed_column(embedder, F.col("text")).alias("vec"))


def split_by_cache(texts: DataFrame, cache: DataFrame, profile: str, role: str = "document") -> tuple[DataFrame, DataFrame]:
    """(hits with their vectors, distinct misses)."""
    keyed = texts.select("text").distinct().withColumn("text_hash", text_key(profile, F.col("text"), role))
    known = cache.where(F.col("profile") == profile).select("text_hash", "vec")
    return keyed.join(known, "text_hash"), keyed.join(known, "text_hash", "left_anti")


def _path(spark: SparkSession, path: str):
    """(file system, path) in the terms of Hadoop, whatever the store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    store, where = _path(spark, path)
    return spark.read.schema(schema).parquet(path) if store.exists(where) else spark.createDataFrame([], schema)


def cache_clear(spark: SparkSession, path: str) -> bool:
    """Deletes a cache; false if there was none."""
    store, where = _path(spark, path)
    return bool(store.delete(where, True))


VECTOR_CACHE = "text_hash string, vec array<double>, profile string"


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The cache of vectors at ``path``, empty if there is none."""
    return _table(spark, path, VECTOR_CACHE)


def embed_cached(texts: DataFrame, path: str, embedder: Embedder, profile: str, role: str = "document") -> DataFrame:
    """Vectors of all distinct texts; misses are embedded and appended to the table at ``path``, partitioned by profile."""
    spark = texts.sparkSession
    _, misses = split_by_cache(texts, opened(spark, path), profile, role)
    fresh = misses.select("text_hash", embed_column(embedder, F.col("text")).alias("vec"), F.lit(profile).alias("profile"))
    fresh.write.mode("append").partitionBy("profile").parquet(path)
    hits, _ = split_by_cache(texts, opened(spark, path), profile, role)
    return hits


CHUNK_CACHE = "chunk_key string, chunks array<struct<chunk_idx:int,start_offset:int,end_offset:int,text:string,tokens:int,lo:int,hi:int>>"


def chunk_cached(docs: DataFrame, configs: list[Config], path: str, build: Callable[[DataFrame, list[Config]], DataFrame]) -> DataFrame:
    """What ``build`` gives for (doc_id, content), by way of a table keyed by content, strategy and parameters.

    Equal contents share an entry, so an entry doesn't know its documents.  Each
    distinct content that the table lacks for some configuration is chunked for
    that configuration and appended.
    """
    spark = docs.sparkSession
    named = F.array(*(F.struct(F.lit(c.id).alias("config_id"), F.lit(c.strategy).alias("strategy"), F.lit(c.params_json).alias("params")) for c in configs))
    wanted = docs.select("doc_id", "content", F.explode(named).alias("c"))
    wanted = wanted.select("doc_id", "content", "c.config_id", chunk_key(F.col("content"), F.col("c.strategy"), F.col("c.params")).alias("chunk_key"))
    known = _table(spark, path, CHUNK_CACHE)
    missing = wanted.join(known.select("chunk_key"), "chunk_key", "left_anti").dropDuplicates(["chunk_key"])
    # Contents stand for documents here, named by their keys.
    chunks = [
        build(missing.where(F.col("config_id") == c.id).select(F.col("chunk_key").alias("doc_id"), "content"), [c]) for c in configs
    ]
    item = F.struct("chunk_idx", "start_offset", "end_offset", "text", "tokens", "lo", "hi")
    found = reduce(DataFrame.unionByName, chunks).groupBy(F.col("doc_id").alias("chunk_key")).agg(F.array_sort(F.collect_list(item)).alias("chunks"))
    # An empty content has no chunks but an entry, so it isn't missing again.
    rows = missing.select("chunk_key").join(found, "chunk_key", "left")
    rows.select("chunk_key", F.coalesce("chunks", F.array().cast(CHUNK_CACHE.split(" ", 3)[3])).alias("chunks")).write.mode("append").parquet(path)
    held = wanted.select("doc_id", "config_id", "chunk_key").join(spark.read.schema(CHUNK_CACHE).parquet(path), "chunk_key")
    return held.select("config_id", "doc_id", F.explode("chunks").alias("k")).select("config_id", "doc_id", "k.*")


def chunk_cache_stats(cache: DataFrame) -> DataFrame:
    """Entries and approximate bytes of a chunk cache."""
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.octet_length(F.to_json("chunks"))), F.lit(0)).cast("long").alias("approx_bytes"))


def cache_stats(cache: DataFrame) -> DataFrame:
    """Rows and approximate bytes."""
    return cache.agg(
        F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.size("vec") * 4 + 32), F.lit(0)).cast("long").alias("approx_bytes")
    )


def scored_text(embedder: Embedder, text: Column, vector: Column) -> Column:
    """Cosine of the text's vector and ``vector``, in the pass that embeds."""

    def run(texts: pd.Series, others: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        left, right = np.stack(list(embedder(texts))), np.stack(others.to_numpy())
        norms = [np.sqrt((m * m).sum(axis=1)) + 1e-9 for m in (left, right)]
        return pd.Series((left * right).sum(axis=1) / (norms[0] * norms[1]))

    run.__annotations__ = {"texts": pd.Series, "others": pd.Series, "return": pd.Series}
    return F.round(F.pandas_udf(run, "double")(text, vector), 9)


#: Bytes of rows that are sent to every task at once.
SENT = 32_000_000
#: Cosines that one block of vectors makes with the queries.
PAIRS = 4_000_000


def slices_of(asked: DataFrame, size: Column, most: int) -> int:
    """Parts of a stated set ``asked`` that have at most about ``most`` rows and ``SENT`` bytes each, a row having ``size``."""
    held = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return max(1, -(-held["n"] // most), -(-int(held["bytes"]) // SENT))


def by_slices(asked: DataFrame, keys: list[str], slices: int, build: Callable[[list[Row]], tuple[DataFrame, Any]]) -> DataFrame:
    """The results of ``build`` for each slice of ``asked``; with several, each is cut off by a checkpoint, and what it sent is let go."""
    spark, found = asked.sparkSession, []
    for k in range(slices):
        rows, sent = build(asked.where(F.pmod(F.xxhash64(*keys), F.lit(slices)) == k).collect())
        if slices > 1 and spark.sparkContext.getCheckpointDir():
            rows = rows.checkpoint()
            sent.destroy()
        found.append(rows)
    return reduce(DataFrame.union, found)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / (np.sqrt((rows * rows).sum(axis=1)) + 1e-9)[:, None]


def _best(query: np.ndarray, sim: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each query, ties by the smaller id."""
    order = np.lexsort((ident, -sim, query))
    sorted_query = query[order]
    first = np.searchsorted(sorted_query, sorted_query)
    return order[np.arange(len(order)) - first < k]


def nearest_by_query(vectors: DataFrame, queries: DataFrame, k: int, most: int = 10_000) -> DataFrame:
    """The ``k`` nearest of ``vectors`` (vec_id, embedding) for each of a stated set of ``queries`` (query_id, query), ties by the smaller id.

    The queries are sent to every task, in slices if they are many.  Each task
    compares its vectors with all of them, block by block, and keeps ``k`` for
    each query, so what is ranked at the end doesn't grow with the vectors but
    with the tasks.  Null vectors are left out.
    """
    from pyspark.sql.window import Window

    spark = vectors.sparkSession
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).where("query IS NOT NULL")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL")
    query_type, vector_type = asked.schema["query_id"].dataType, rows.schema["vec_id"].dataType
    schema = StructType([StructField("query_id", query_type), StructField("vec_id", vector_type), StructField("sim", DoubleType())])

    def compared(some: list[Row]) -> tuple[DataFrame, Any]:
        sent = spark.sparkContext.broadcast(([r["query_id"] for r in some], np.array([r["query"] for r in some])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            if not ids:
                return
            unit = _unit(matrix)
            query, sim, ident = np.zeros(0, dtype=np.int64), np.zeros(0), None
            step = max(1, PAIRS // len(ids))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    own = part.column(0).to_numpy(zero_copy_only=False)
                    values = part.column(1)
                    cosine = np.round(_unit(values.flatten().to_numpy().reshape(part.num_rows, -1)) @ unit.T, 9)
                    low = np.partition(cosine, max(0, len(own) - k), axis=0)[max(0, len(own) - k)]
                    r, q = np.nonzero(cosine >= low)
                    query, sim = np.concatenate([query, q]), np.concatenate([sim, cosine[r, q]])
                    ident = own[r] if ident is None else np.concatenate([ident, own[r]])
                    if len(query) > 4 * k * len(ids):
                        keep = _best(query, sim, ident, k)
                        query, sim, ident = query[keep], sim[keep], ident[keep]
            if len(query):
                keep = _best(query, sim, ident, k)
                columns = [pa.array([ids[i] for i in query[keep]], to_arrow_type(query_type)), pa.array(ident[keep], to_arrow_type(vector_type)), pa.array(sim[keep])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "sim"])

        return rows.mapInArrow(run, schema), sent

    best = by_slices(asked, ["query_id"], slices_of(asked, F.size("query") * 8, most), compared)
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return best.withColumn("sim", F.round("sim", 9)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
