"""Secret scans with a trigram inverted index (operator 4), in DataFrame functions only.

Each rule's regex yields a Boolean query over trigrams.  One pass over each text
posts those of its trigrams that some rule names; postings are intersected
alternative by alternative; only candidates of a rule are verified with its
regex.  A rule without a mandatory trigram scans every document.

Defined results: a null or empty text has no spans; a document is a pair of id
and text, so identical repeated rows get equal results and null ids work; an
empty table gives an empty result; the caller's columns travel in one struct
and cannot clash; scanning is linear in a text, and no rule recurses on it.
Spans are in code points, end exclusive; those that start together go by the order of
the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, let, running, spool, table, text_of
from .trigrams import any_of, trigram_query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Matches whose ``group`` is shorter than this are dropped after matching.
    least: int = 1
    group: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    # Maximal runs; the lookbehind only spares starts within a run.
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 24),
)
ADDED = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    # A header has at most 1,000 characters, so what a failed start costs is bounded.
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # A repeated class is matched in a loop; a repeated group would recurse on long texts.
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED


def _digest(column: str = "text") -> Column:
    return F.xxhash64(text_of(column))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc, digest, kinds): the rules whose trigram query a document meets."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    terms = [
        (kind, n, len(clause), gram)
        for kind, query in queries.items()
        for n, clause in enumerate(sorted(query, key=sorted))
        for gram in sorted(clause)
    ]
    # Lower case of any letter at most adds candidates; one pass over a text finds all trigrams that the rules name.
    held = F.regexp_extract_all(F.lower(text_of()), F.lit(any_of({t[3] for t in terms})), F.lit(1))
    postings = docs.select(F.col("doc_id").alias("doc"), _digest().alias("digest"), F.explode(F.array_distinct(held)).alias("gram")).distinct()
    clause = F.array(
        *(F.struct(F.lit(k).alias("kind"), F.lit(c).alias("clause"), F.lit(n).alias("size"), F.lit(g).alias("gram")) for k, c, n, g in terms)
    )
    # A few dozen literal rows, fixed by the rules.
    wanted = docs.sparkSession.range(1).select(F.explode(clause).alias("t")).select("t.*")
    met = (
        postings.join(F.broadcast(wanted), "gram")
        .groupBy("doc", "digest", "kind", "clause", "size")
        .agg(F.count(F.lit(1)).alias("found"))
        .where(F.col("found") == F.col("size"))
    )
    return met.groupBy("doc", "digest").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """(start, order, end, kind) of the rule's matches, leftmost and not overlapping."""
    pattern = rule.java
    size = lambda parts: F.transform(parts, lambda x: F.length(x))

    def placed(long: Column, gaps: Column) -> Column:
        before = running(F.zip_with(gaps, long, lambda g, m: g + F.coalesce(m, F.lit(0))), lambda a, x: a + x)
        return F.zip_with(
            long,
            F.zip_with(F.slice(before, F.lit(1), F.size(long)), F.slice(gaps, F.lit(1), F.size(long)), lambda a, b: a + b),
            lambda m, at: F.struct(
                at.cast("long").alias("start"),
                F.lit(order).alias("order"),
                (at + m).cast("long").alias("end"),
                F.lit(rule.kind).alias("kind"),
            ),
        )

    found = size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    spans = let(found, lambda m: let(size(F.split(text, pattern)), lambda g: placed(m, g)))
    if rule.least <= 1:
        return spans
    part = size(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)))
    return let(part, lambda p: F.filter(spans, lambda _, i: F.get(p, i) >= rule.least))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """Every column of ``docs`` and ``into``, an array of (start, order, end, kind) by start, then rule.

    A column of ``docs`` that is called ``into`` is replaced.
    """
    known = spool(candidates(docs, rules), "candidates")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row_"), _digest().alias("its")
    )
    both = rows.join(known, F.col("_row_.doc_id").eqNullSafe(F.col("doc")) & (F.col("its") == F.col("digest")), "left")
    text = text_of("_row_.text")
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    each = []
    for order, rule in enumerate(rules):
        to_check = F.lit(True) if trigram_query(rule.pattern) is None else F.array_contains("kinds", rule.kind)
        if trigram_query(rule.pattern) is None:
            to_check = text.rlike(rule.java)
        each.append(F.when(F.coalesce(to_check, F.lit(False)), _spans(text, rule, order)).otherwise(none))
    own = [F.col(f"_row_.`{c}`").alias(c) for c in docs.columns if c != into]
    return both.select(*own, F.sort_array(F.concat(*each)).alias(into))


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every column of ``docs``, with each secret of ``text`` replaced by its kind in angle brackets; a null text stays null."""
    into = free_name("secrets", docs.columns)
    found = find_secrets(docs, rules, into)
    text = F.when(F.size(into) == 0, F.col("text")).otherwise(masked(text_of(), F.col(into)))
    return found.withColumn("text", text).select(*(F.col(f"`{c}`") for c in docs.columns))


#: Code points of a block that masked texts are put together from.
BLOCK = 1024


def masked(text: Column, secrets: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; a span within an earlier one goes with it.

    Spans come sorted by start, so a running end tells which begin inside an
    earlier one; what lies between is joined as it is.
    """

    def placed(s: Column) -> Column:
        done = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        return F.zip_with(
            s, done, lambda x, d: F.struct(x["start"].alias("a"), x["end"].alias("b"), x["kind"].alias("k"), d.alias("done"))
        )

    def between(blocks: Column, a: Column, b: Column) -> Column:
        """From a to b: of the blocks that hold it, so that a long text isn't walked through for each span."""
        first = F.floor(a / BLOCK)
        held = F.slice(blocks, (first + 1).cast("int"), (F.floor(b / BLOCK) - first + 1).cast("int"))
        return F.substring(F.array_join(held, ""), (a - first * BLOCK + 1).cast("int"), (b - a).cast("int"))

    def pieces(blocks: Column, e: Column) -> Column:
        head = F.transform(
            e,
            lambda x: F.when(x["a"] >= x["done"], F.concat(between(blocks, x["done"], x["a"]), F.lit("<"), x["k"], F.lit(">"))).otherwise(F.lit("")),
        )
        last = F.array_max(F.transform(e, lambda x: x["b"]))
        return F.concat(F.array_join(head, ""), F.substring(text, (last + 1).cast("int"), F.length(text)))

    whole = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(secrets) == 0, text).otherwise(let(whole, lambda blocks: let(let(secrets, placed), lambda e: pieces(blocks, e))))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["order"] < len(BASE))
    return found.select(
        "doc_id",
        *(of(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(_said(base), 256).alias("base_sha256"),
        _said(F.col("secrets")).alias("spans"),
    )
