"""Quality rules with host verdicts (operator 1), in DataFrame functions only.

Every text gets base counts and a few rule outcomes, all within its own row.
Outcomes are summed by host; each host's failure rates are shrunk towards the
corpus by a beta prior fitted to the hosts themselves, and the host's verdict
is joined back to its documents.

Defined results: a null text counts as empty (no words, so it fails the length
rule); rows with a null host form one host; repeated rows each get their own
result and each count for their host; an empty table gives an empty result.
Columns of the input other than the named ones are ignored, so their names
cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, spool, table, text_of


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    repeat_share: float = 0.5
    symbols_per_word: float = 0.1
    dup_line_share: float = 0.3
    mean_word: tuple[float, float] = (2.0, 12.0)
    #: A host goes when its shrunk rate of failing documents is above this.
    host_rate: float = 0.5


#: Rules summed by host; the first two make up ``base_failed``.
RULES = ("short", "repetitive", "symbols", "dup_lines", "word_length")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are compared by XXH64 of their words.  A text without equal windows
    is done after one hash set; else windows are sorted by (hash, place), so
    the cost stays n log n on any text.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def places(by_hash: Column) -> Column:
        twice = F.filter(
            by_hash,
            lambda x, k: F.coalesce(x["h"] == F.get(by_hash, k - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(by_hash, k + 1)["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(by_hash, lambda s: let(places(s), covered))
        )

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def base_counts(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """doc_id, host, the five counts and a boolean for each of ``RULES``."""
    text, word = text_of(), rf"[{SPACE}]+"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
    rows = docs.select(
        "doc_id",
        F.col(host).cast("string").alias("host"),
        F.array_remove(F.split(text, word), "").alias("words"),
        lines.alias("lines"),
    )
    rows = rows.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.array_join("words", "").alias("solid"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    rows = rows.select(
        "doc_id",
        "host",
        "n_words",
        F.length("solid").cast("long").alias("word_chars"),
        F.regexp_count("solid", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        "n_lines",
    )
    n, mean = F.col("n_words"), F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    low, high = limits.mean_word
    return rows.withColumns(
        {
            "short": n < limits.min_words,
            "repetitive": F.col("n_repeat_words") > limits.repeat_share * n,
            "symbols": F.col("n_symbols") > limits.symbols_per_word * n,
            "dup_lines": F.col("n_dup_lines") > limits.dup_line_share * F.col("n_lines"),
            "word_length": (n > 0) & ((mean < low) | (mean > high)),
        }
    )


def host_verdicts(counts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row a host: documents, shrunk failure rate of each rule and of any rule, and ``host_kept``.

    The prior of a rule is Beta(a, b) by moments: the mean is the corpus rate,
    the spread is the variance between hosts less what sampling alone gives.
    Its figures are one row, the only thing that comes to the driver.
    """
    names = (*RULES, "any_rule")
    failed = counts.withColumn("any_rule", F.greatest(*RULES))
    hosts = failed.groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"), *(F.sum(F.col(r).cast("long")).alias(r) for r in names)
    )
    hosts = spool(hosts, "hosts")
    total = hosts.agg(
        F.sum("docs").alias("docs"),
        F.count(F.lit(1)).alias("hosts"),
        *(F.sum(r).alias(r) for r in names),
        *(F.sum(F.col(r) * F.col(r) / F.col("docs")).alias(f"{r}_sq") for r in names),
    ).first()
    if not total["docs"]:
        return hosts.select("host", "docs", *(F.lit(0.0).alias(r) for r in names), F.lit(True).alias("host_kept"))
    rates = {}
    for r in names:
        mean = total[r] / total["docs"]
        within = mean * (1 - mean)
        between = total[f"{r}_sq"] / total["docs"] - mean * mean - within * total["hosts"] / total["docs"]
        weight = min(max(within / between - 1, 1.0), 1e6) if between > 0 else 1e6
        rates[r] = (F.col(r) + mean * weight) / (F.col("docs") + weight)
    return hosts.select("host", "docs", *(rates[r].alias(r) for r in names)).withColumn(
        "host_kept", F.col("any_rule") <= limits.host_rate
    )


def quality_rules(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """All of ``base_counts``, with ``base_failed``, ``host_kept`` and ``kept``.

    A document is kept if it passes every rule and its host is kept.  The join
    with hosts is outer on the documents' side, so a host with a third of all
    rows can be split, and a host table small enough is broadcast by size.
    """
    counts = spool(base_counts(docs, host, limits), "counts")
    verdicts = host_verdicts(counts, limits).select(F.col("host").alias("its_host"), "host_kept")
    joined = counts.join(verdicts, F.col("host").eqNullSafe(F.col("its_host")), "left").drop("its_host")
    failed = F.col("short") | F.col("repetitive")
    return joined.withColumn("base_failed", failed).withColumn(
        "kept", ~F.greatest(*RULES) & F.coalesce(F.col("host_kept"), F.lit(True))
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_kept"
    )
