"""Weighted scores, profiles and rankings of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Weights of the four use cases.
PROFILES = {
    "rag_qa": {"token_recall": 0.45, "mrr": 0.30, "token_iou": 0.15, "faithfulness": 0.10, "duplication_ratio": -0.10},
    "search": {"recall_at_1": 0.50, "mrr": 0.35, "duplication_ratio": -0.15},
    "summarization": {"token_recall": 0.60, "token_iou": 0.20, "duplication_ratio": -0.20},
    "code_assist": {"token_recall": 0.50, "mrr": 0.35, "duplication_ratio": -0.15},
}
MOST_DUPLICATION = 0.3


def weights_for(use_case: str, custom: dict[str, float] | None = None) -> dict[str, float]:
    """``custom`` if given, else the profile; an unknown use case is rag_qa.  One weight must be positive."""
    weights = custom or PROFILES.get(use_case, PROFILES["rag_qa"])
    if not any(w > 0 for w in weights.values()):
        raise ValueError("at least one weight must be positive")
    return dict(weights)


def score(metrics: DataFrame, weights: dict[str, float]) -> Column:
    """Sum of weight times metric; metrics that aren't there, or are null, count as 0."""
    terms = (F.lit(w) * F.coalesce(F.col(m), F.lit(0.0)) for m, w in weights.items() if m in metrics.columns)
    return sum(terms, F.lit(0.0))


def by_profile(metrics: DataFrame) -> DataFrame:
    """A row for each configuration and use case."""
    scores = F.array(*(F.struct(F.lit(u).alias("use_case"), score(metrics, w).alias("score")) for u, w in PROFILES.items()))
    return metrics.select("config_id", F.explode(scores).alias("s")).select("config_id", "s.use_case", "s.score")


def ranked(metrics: DataFrame, order: list[str], weights: dict[str, float], baseline: str | None = None) -> DataFrame:
    """Best first, ties in grid order; ``order`` lists the configuration ids, a bounded set."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("config_id"))
    scored = metrics.withColumn("score", F.round(score(metrics, weights), 9))
    scored = scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), place)))
    return scored.withColumns(
        {
            "is_best": F.col("rank") == 1,
            "is_baseline": F.col("config_id") == F.lit(baseline) if baseline else F.lit(False),
            "disqualified": F.col("duplication_ratio") > MOST_DUPLICATION,
        }
    )


def against_baseline(ranking: DataFrame) -> DataFrame:
    """The best score less the baseline's, and in per cent of it (0 where that is 0)."""
    pair = ranking.agg(F.max(F.when(F.col("is_best"), F.col("score"))).alias("best"), F.max(F.when(F.col("is_baseline"), F.col("score"))).alias("base"))
    delta = F.col("best") - F.col("base")
    return pair.select("best", "base", delta.alias("delta"), F.when(F.col("base") != 0, 100 * delta / F.col("base")).otherwise(0.0).alias("delta_pct"))
