"""Whole jobs: recommend, compare, preview, estimate, analyze."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.text import HEADING, content_type, token_count, trim_ends
from ..operators.chunkers import chunk
from ..operators.datasets import trivial
from ..operators.embed import Embedder, hash_embedder
from ..operators.evaluate import by_config, grid_metrics, grid_stats, with_effective_k
from ..operators.score import against_baseline, ranked, weights_for
from ..schema import TYPES, Config
from .strategies import REGISTRY

#: Dollars for a million tokens, and tokens a minute, where no price list is at hand.
EMBED_PRICE, ASK_PRICE, PER_MINUTE = 0.02, 0.15, 200_000
PREVIEW_CHARS = 500_000


def guarded(docs: DataFrame, configs: list[Config]) -> DataFrame:
    """``docs`` that fail when read if the type of one is no type of some configuration's strategy; a missing type counts as text."""
    fits = [set(REGISTRY.get(c.strategy).types) for c in configs]
    common = sorted(set(TYPES).intersection(*fits))
    kind = F.coalesce("content_type", F.lit("text"))
    names = ", ".join(sorted({c.strategy for c in configs}))
    wrong = F.raise_error(F.concat(F.lit(f"not all of {names} take content of type "), kind))
    return docs.withColumn("content", F.when(kind.isin(common), F.col("content")).otherwise(wrong.cast("string")))


def chunked(docs: DataFrame, configs: list[Config], **how: Any) -> DataFrame:
    """Chunks for checked configurations, with the kernels of registered strategies and, if ``docs`` has types, their guard."""
    for c in configs:
        REGISTRY.check(c)
    return chunk(guarded(docs, configs) if "content_type" in docs.columns else docs, configs, own=REGISTRY.kernels(), **how)


def recommend(
    docs: DataFrame,
    configs: list[Config],
    queries: DataFrame | None = None,
    use_case: str = "rag_qa",
    weights: dict[str, float] | None = None,
    embedder: Embedder | None = None,
    budget: int = 2000,
    recorded: DataFrame | None = None,
) -> DataFrame:
    """Every configuration with its metrics, score and rank; the first one is the baseline.

    Two passes over the corpus: the first sums up chunk sizes, which tell how
    many chunks fit the budget; the second chunks, embeds, ranks and measures
    each document where it is read.  Neither chunks nor vectors are stored or
    moved.  The result has a row for each configuration, so it is computed here.
    A configuration that failed on some document has ``error`` and no rank; if
    all failed, the first error is raised.  ``scoring_ms`` is the time that both
    passes took for the whole grid.
    """
    for c in configs:
        REGISTRY.check(c)
    docs = guarded(docs, configs) if "content_type" in docs.columns else docs
    queries = trivial(docs) if queries is None else queries
    spark, own, start = docs.sparkSession, REGISTRY.kernels(), time.perf_counter()
    stats = with_effective_k(grid_stats(docs, configs, own, recorded), budget)
    sizes = stats.collect()
    failed = {r["config_id"]: r["error"] for r in sizes if r["error"] is not None}
    if configs and len(failed) == len({c.id for c in configs}):
        raise RuntimeError(f"all configurations failed, the first with {failed[configs[0].id]}")
    good = [r for r in sizes if r["config_id"] not in failed and r["n_chunks"]]
    fits = {r["config_id"]: r["effective_k"] for r in good}
    each = grid_metrics(docs, queries, [c for c in configs if c.id in fits], fits, embedder or hash_embedder(0), own, recorded)
    metrics = by_config(each, spark.createDataFrame(good, stats.schema), queries)
    ranking = ranked(metrics, [c.id for c in configs], weights_for(use_case, weights), configs[0].id)
    rows = [r.asDict() | {"error": None} for r in ranking.collect()]
    rows += [{"config_id": c, "is_best": False, "is_baseline": c == configs[0].id, "error": e} for c, e in failed.items()]
    spent = round((time.perf_counter() - start) * 1000, 1)
    schema = StructType([*ranking.schema, StructField("error", StringType()), StructField("scoring_ms", DoubleType())])
    schema = StructType([StructField(f.name, f.dataType) for f in schema])
    return spark.createDataFrame([tuple((r | {"scoring_ms": spent}).get(n) for n in schema.names) for r in rows], schema)


def recommend_mixed(docs: DataFrame, names: list[str] | None = None, use_case: str = "rag_qa") -> dict[str, DataFrame]:
    """A ranking for each content type in ``docs``, of those that there are; others have no strategies."""
    found = {r[0] for r in docs.where(F.col("content_type").isin(list(TYPES))).select("content_type").distinct().collect()}
    return {t: recommend(docs.where(F.col("content_type") == t), REGISTRY.configs(t, names), use_case=use_case) for t in sorted(found)}


def compare(docs: DataFrame, names: list[str], queries: DataFrame | None = None) -> DataFrame:
    """The first grid point of each named strategy."""
    return recommend(docs, [Config(n, REGISTRY.get(n).grid[0]) for n in names], queries)


def summary(ranking: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: documents, queries, configurations, failed ones, the best one with its score, and what it gains on the baseline."""
    counts = ranking.agg(F.count(F.lit(1)).alias("configs"), F.count("error").alias("failed"), F.max(F.when(F.col("is_best"), F.col("config_id"))).alias("best_config"))
    row = {"documents": docs.count(), "queries": queries.count()} | counts.first().asDict() | against_baseline(ranking).first().asDict()
    schema = "documents long, queries long, configs long, failed long, best_config string, best double, base double, delta double, delta_pct double"
    return docs.sparkSession.createDataFrame([tuple(row.values())], schema)


def preview(spark: SparkSession, text: str, config: Config, most: int = PREVIEW_CHARS) -> DataFrame:
    """Chunks of one text, their texts shortened to 120 characters."""
    if len(text) > most:
        raise ValueError(f"a preview takes at most {most} characters")
    docs = spark.createDataFrame([("preview", text)], "doc_id string, content string")
    return shortened(chunked(docs, [config]))


def shortened(chunks: DataFrame, most: int = 120) -> DataFrame:
    text = F.when(F.length("text") > most, F.concat(F.left("text", F.lit(most)), F.lit("..."))).otherwise(F.col("text"))
    return chunks.select("doc_id", "chunk_idx", "start_offset", "end_offset", "tokens", text.alias("preview"))


def estimate(docs: DataFrame, n_configs: int, ask: bool = True) -> DataFrame:
    """One row: tokens to embed, cost of embedding and of questions, minutes, configurations."""
    n, tokens = F.count(F.lit(1)), F.coalesce(F.sum(token_count(F.col("content"))), F.lit(0))
    row = docs.agg(n.alias("n"), tokens.alias("t"))
    heuristic = F.floor(F.col("n") * 3.0 * n_configs * 64) + F.col("n") * 32 * n_configs
    row = row.withColumn("total_tokens", F.greatest(heuristic, F.floor(F.col("t") * n_configs / 4)).cast("long"))
    asked = F.greatest(F.lit(1), 2 * F.col("n")) * 400 * ASK_PRICE / 1e6 if ask else F.lit(0.0)
    return row.select(
        "total_tokens",
        F.round(F.col("total_tokens") * EMBED_PRICE / 1e6, 6).alias("embedding_cost_usd"),
        F.round(asked, 6).cast("double").alias("llm_cost_usd"),
        F.round(F.col("total_tokens") / PER_MINUTE, 3).alias("estimated_wall_time_min"),
        F.lit(n_configs).cast("long").alias("strategy_configs"),
    )


def analyze(docs: DataFrame) -> DataFrame:
    """Structure of each document and the strategy to start with."""
    text = F.col("content")
    paragraphs = F.filter(F.split(text, "\n\n"), lambda p: trim_ends(p) != "")
    n = F.greatest(F.size("paragraphs"), F.lit(1))
    rows = docs.select(
        "doc_id",
        token_count(text).cast("long").alias("token_count"),
        F.regexp_count(text, F.lit(HEADING)).cast("long").alias("header_hits"),
        F.floor(F.regexp_count(text, F.lit("(?md)^```")) / 2).alias("fenced_code_blocks"),
        paragraphs.alias("paragraphs"),
    )
    chars = F.aggregate("paragraphs", F.lit(0).cast("long"), lambda a, p: a + F.length(p))
    hint = F.when(F.col("fenced_code_blocks") > 3, "code_ast").when(F.col("header_hits") / n > 0.4, "markdown_semantic").otherwise("recursive_character")
    return rows.select("doc_id", "token_count", "header_hits", "fenced_code_blocks", F.round(chars / n, 1).alias("avg_paragraph_chars"), hint.alias("hint"))


def with_types(docs: DataFrame) -> DataFrame:
    """``content_type`` from path and content."""
    return docs.withColumn("content_type", content_type(F.col("path"), F.col("content")))
