"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import html_text, quality_rules, secret_scan

_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS t, source AS host FROM documents)"
_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _quality() -> str:
    x = quality_rules.Limits()
    low, high = x.mean_word
    rules = {
        "short": f"n_words < {x.min_words}",
        "repetitive": f"n_repeat_words > {x.repeat_share}::DOUBLE * n_words",
        "symbols": f"n_symbols > {x.symbols_per_word}::DOUBLE * n_words",
        "dup_lines": f"n_dup_lines > {x.dup_line_share}::DOUBLE * n_lines",
        "word_length": f"n_words > 0 AND (word_chars::DOUBLE / greatest(n_words, 1) < {low} OR word_chars::DOUBLE / greatest(n_words, 1) > {high})",
    }
    return rf"""WITH {_DOCS},
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a) AS n FROM
  (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS a FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda s: length(s))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(ls)::BIGINT AS n_lines FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, {", ".join(f"({v}) AS {k}" for k, v in rules.items())} FROM b),
a AS (SELECT *, ({" OR ".join(rules)}) AS failed FROM f),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS x FROM a GROUP BY host),
s AS (SELECT sum(x) / sum(n) AS m, sum(x * x / n) / sum(n) AS sq, count(*) / sum(n) AS per FROM h),
p AS (SELECT m, CASE WHEN sq - m * m - m * (1 - m) * per > 0 THEN least(greatest(m * (1 - m) / (sq - m * m - m * (1 - m) * per) - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM s),
v AS (SELECT host, (x + m * k) / (n + k) <= {x.host_rate} AS host_kept FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short OR repetitive) AS base_failed, (NOT failed AND host_kept) AS kept, host_kept
FROM a JOIN v ON a.host IS NOT DISTINCT FROM v.host"""


def _lines() -> str:
    return f"""WITH {_DOCS},
l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d)),
k AS (SELECT *, trim(translate(x, '{_UPPER}', '{_UPPER.lower()}'), {_SPACES}) AS y FROM l),
c AS (SELECT y FROM k WHERE y <> '' GROUP BY y HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, c.y IS NULL AS stays FROM k LEFT JOIN c ON c.y = k.y)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


def _secrets() -> str:
    parts = []
    for order, r in enumerate(secret_scan.RULES):
        # No lookbehind here: maximal runs, the short ones dropped afterwards.
        pattern = (r"[0-9a-f]+" if r.kind == "hex" else r.java).replace("'", "''")
        parts.append(
            f"SELECT doc_id, {order} AS o, '{r.kind}' AS kind, regexp_extract_all(t, '{pattern}') AS ms, "
            f"regexp_extract_all(t, '{pattern}', {r.group}) AS gs, string_split_regex(t, '{pattern}') AS gaps, {r.least} AS least FROM d"
        )
    base = len(secret_scan.BASE)
    said = "kind || ':' || s || ':' || (s + length(ms[k]))"
    return f"""WITH {_DOCS}, f AS ({" UNION ALL ".join(parts)}),
x AS (SELECT doc_id, o, kind, {said} AS said, s FROM (SELECT *, list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda g: length(g))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM f) WHERE length(gs[k]) >= least)),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)},
  string_agg(said, ',' ORDER BY s, o) FILTER (o < {base}) AS base, string_agg(said, ',' ORDER BY s, o) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""


def _repeats(length: int = 100) -> str:
    """Every string of ``length`` bytes, as twice as many hexadecimal digits, against all others."""
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * length}) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - {length - 1}, 0))) AS i FROM d)),
g AS (SELECT doc_id, i AS a, i + {length} AS b FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
m AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
t AS (SELECT doc_id, a, b, sum((before IS NULL OR before < a)::INT) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM m),
r AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM t GROUP BY doc_id, run),
p AS (SELECT r.*, h, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS behind FROM r JOIN d ON d.doc_id = r.doc_id),
k AS (SELECT doc_id, string_agg(substr(h, (2 * behind + 1)::BIGINT, (2 * (a - behind))::BIGINT), '' ORDER BY a) AS head, max(b) AS stop, count(*) AS n, sum(b - a) AS gone FROM p GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(stop, 0) + 1)::BIGINT))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""


def _pages() -> str:
    """The one article element of each page of these tables, cut at block tags; SQL has no general reader of HTML."""
    tags = "|".join(sorted(html_text.BLOCK))
    text = "regexp_replace(x, '<[^>]*>', '', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    return f"""WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:{tags})(?:\\s[^>]*)?>'), lambda x: trim(regexp_replace({text}, '[ \\t\\r\\n\\f]+', ' ', 'g'))) AS parts FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), ' ') AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c"""


SQL: dict[str, str] = {
    "op1_quality_rules": _quality(),
    "op4_secret_scan": _secrets(),
    "op5_line_dedup": _lines(),
    "op8_html_text": _pages(),
    "op10_suffix_dedup": _repeats(),
}
