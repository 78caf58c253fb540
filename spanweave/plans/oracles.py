"""DuckDB SQL for the catalogue, written from the definitions and apart from the Spark plans.

Metrics count exploded token positions here, where the plans use intervals;
scanners are recursive queries here, where the plans use kernels.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from ..operators.score import PROFILES
from ..schema import Config

TOKEN = r"[^ \t\n\r]+[ \t\n\r]*|[ \t\n\r]+"
WS = "' '||chr(9)||chr(10)||chr(13)"
DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS content FROM documents)"
TOKENS = f"""t AS (SELECT doc_id, content, regexp_extract_all(content, '{TOKEN}') AS tk FROM d),
tok AS (SELECT doc_id, i, e - length(w) AS s, e FROM (SELECT doc_id, i, w, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e
  FROM (SELECT doc_id, unnest(range(len(tk))) AS i, unnest(tk) AS w FROM t)))"""


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fixed(configs: Iterable[tuple[str, int, int]], source: str = "t") -> str:
    rows = ", ".join(f"({lit(c)}, {m}, {s})" for c, m, s in configs)
    return f"""fx AS (SELECT config_id, doc_id, tk, content, most, len(tk) AS n, unnest(range(0, greatest(len(tk) - most, 0) + step, step)) AS lo
  FROM {source}, (VALUES {rows}) v(config_id, most, step) WHERE len(tk) > 0),
fixed_chunks AS (SELECT config_id, doc_id, (row_number() OVER (PARTITION BY config_id, doc_id ORDER BY lo) - 1)::INT AS chunk_idx,
  coalesce(length(array_to_string(tk[1:lo], '')), 0)::INT AS start_offset, coalesce(length(array_to_string(tk[1:least(n, lo + most)], '')), 0)::INT AS end_offset,
  array_to_string(tk[lo + 1:least(n, lo + most)], '') AS text, (least(n, lo + most) - lo)::INT AS tokens, lo::INT AS lo, least(n, lo + most)::INT AS hi FROM fx)"""


def separators(config_id: str, size: int, overlap: int, seps: list[str], source: str = "d", name: str = "rc") -> str:
    """A recursive scan; each step finds the end of one window."""

    def chars(s: str) -> str:
        return "||".join(f"chr({ord(c)})" for c in s)

    arms = " ".join(f"WHEN strpos(w, {chars(s)}) > 0 THEN a + length(w) - strpos(reverse(w), {chars(s[::-1])}) + 1" for s in seps if s)
    cut = f"CASE WHEN a + {size} >= n THEN n {arms} ELSE a + {size} END"
    step = f"""SELECT doc_id, a, CASE WHEN a + {size} < n AND cut - a <= {overlap} THEN a + {size} ELSE cut END AS b, n FROM
  (SELECT *, {cut} AS cut FROM (SELECT doc_id, a, n, substr(content, a + 1, {size}) AS w FROM (%s)))"""
    first = f"SELECT doc_id, content, 0 AS a, length(content) AS n FROM {source} WHERE content <> ''"
    later = f"SELECT {name}.doc_id, content, greatest({name}.a + 1, {name}.b - {overlap}) AS a, n FROM {name} JOIN {source} ON {name}.doc_id = {source}.doc_id WHERE {name}.b < n"
    return f"""{name}(doc_id, a, b, n) AS ({step % first} UNION ALL {step % later}),
{name}_chunks AS (SELECT {lit(config_id)} AS config_id, {name}.doc_id, (row_number() OVER (PARTITION BY {name}.doc_id ORDER BY a) - 1)::INT AS chunk_idx,
  a::INT AS start_offset, b::INT AS end_offset, substr(content, a + 1, b - a) AS text FROM {name} JOIN {source} ON {name}.doc_id = {source}.doc_id)"""


TOUCHED = """SELECT c.config_id, c.doc_id, c.chunk_idx, c.start_offset, c.end_offset, c.text, len(regexp_extract_all(c.text, '{tok}'))::INT AS tokens,
  min(i)::INT AS lo, (max(i) + 1)::INT AS hi FROM {chunks} c JOIN tok ON tok.doc_id = c.doc_id AND tok.s < c.end_offset AND tok.e > c.start_offset
  GROUP BY ALL"""
CHUNK_COLUMNS = "config_id, doc_id, chunk_idx, start_offset, end_offset, text, tokens"


def vectors(source: str, seed: int = 0) -> str:
    """(t, norm, v): the 256 numbers of each distinct text, before scaling."""
    number = "('0x' || substr(h, j*8+7, 2) || substr(h, j*8+5, 2) || substr(h, j*8+3, 2) || substr(h, j*8+1, 2))::UBIGINT / 4294967296.0"
    return f"""tx AS (SELECT DISTINCT t FROM {source}),
hx(t, k, h) AS (SELECT t, 0, sha256('{seed}:' || t) FROM tx UNION ALL SELECT t, k + 1, sha256(unhex(h)) FROM hx WHERE k < 31),
vec AS (SELECT t, sqrt(sum(x * x)) AS norm, list(x ORDER BY k, j) AS v FROM (SELECT t, k, j, {number} AS x FROM hx, range(8) r(j)) GROUP BY t)"""


TRIVIAL = """q AS (SELECT 'q_' || doc_id AS query_id, doc_id, 'What information appears at the start of this document?' AS question,
  0 AS a, greatest(least(length(content), 200), 1) AS b FROM d)"""
GOLD = """g AS (SELECT query_id, q.doc_id, min(i) AS g_lo, max(i) + 1 AS g_hi FROM q JOIN tok ON tok.doc_id = q.doc_id AND tok.s < q.b AND tok.e > q.a GROUP BY ALL)"""


def evaluation(chunks: str, budget: int = 2000) -> str:
    """From a CTE ``ch`` (with lo, hi) to per-query metrics in ``m`` and means in ``mm``; needs d, t, tok."""
    e = "1e-9"
    return f"""{chunks}, {TRIVIAL}, {GOLD},
st AS (SELECT config_id, count(*) AS n_chunks, avg(tokens) AS avg_len, stddev_pop(tokens) AS std_len, sum(tokens)::BIGINT AS tot,
  greatest(1, floor({budget}.0::DOUBLE / avg(tokens)))::INT AS ek FROM ch GROUP BY config_id),
src AS (SELECT text AS t FROM ch UNION SELECT question FROM q),
{vectors("src")},
pr AS (SELECT ch.config_id, g.query_id, ch.doc_id, chunk_idx, lo, hi, tokens, g_lo, g_hi, (lo < g_hi AND hi > g_lo)::INT AS rel, ch.text AS ct, q.question AS qt
  FROM ch JOIN q ON q.doc_id = ch.doc_id JOIN g ON g.query_id = q.query_id),
sm AS (SELECT ct, qt, round(list_dot_product(a.v, b.v) / ((a.norm + {e}) * (b.norm + {e}) * (a.norm / (a.norm + {e}) + {e}) * (b.norm / (b.norm + {e}) + {e})), 9) AS sim
  FROM (SELECT DISTINCT ct, qt FROM pr) JOIN vec a ON a.t = ct JOIN vec b ON b.t = qt),
rk AS (SELECT pr.*, sim, row_number() OVER (PARTITION BY config_id, query_id ORDER BY sim DESC, chunk_idx) AS rank FROM pr JOIN sm USING (ct, qt)),
tp AS (SELECT rk.*, ek FROM rk JOIN st USING (config_id) WHERE rank <= ek),
ps AS (SELECT config_id, query_id, p, count(*) AS depth, (p >= g_lo AND p < g_hi)::INT AS gold FROM (SELECT *, unnest(range(lo, hi)) AS p FROM tp) GROUP BY ALL),
pc AS (SELECT config_id, query_id, count(*) AS covered, sum(gold) AS hits, count(*) FILTER (depth > 1) AS twice FROM ps GROUP BY ALL),
pt AS (SELECT config_id, query_id, count(*) AS top_n, sum(tokens)::BIGINT AS tokens_in_context FROM tp GROUP BY ALL),
pk AS (SELECT config_id, query_id, min(g_hi - g_lo) AS gs, min(rank) FILTER (rel = 1) AS fr,
  {", ".join(f"coalesce(max(rel) FILTER (rank <= {k}), 0)::DOUBLE AS recall_at_{k}, coalesce(sum(rel / log2(rank + 1)) FILTER (rank <= {k}), 0) AS dcg_{k}, coalesce(sum(rel) FILTER (rank <= {k}), 0) AS f_{k}" for k in (1, 3, 5))}
  FROM rk GROUP BY ALL),
m AS (SELECT config_id, query_id, hits / covered AS token_precision, hits / gs AS token_recall, hits / (covered + gs - hits) AS token_iou,
  recall_at_1, recall_at_3, recall_at_5, coalesce(1.0 / fr, 0) AS mrr,
  {", ".join(f"CASE WHEN f_{k} > 0 THEN dcg_{k} / list_sum(list_transform(range(1, f_{k}::BIGINT + 1), lambda j: 1 / log2(j + 1))) ELSE 0 END AS ndcg_at_{k}" for k in (1, 3, 5))},
  CASE WHEN top_n < 2 THEN 0 ELSE twice / covered END AS duplication_ratio, tokens_in_context
  FROM pk JOIN pc USING (config_id, query_id) JOIN pt USING (config_id, query_id)),
mm AS (SELECT config_id, {", ".join(f"avg({x})::DOUBLE AS {x}" for x in MEANS)}, avg(tokens_in_context) AS avg_tokens_per_query FROM m GROUP BY config_id),
al AS (SELECT st.config_id, {", ".join(f"coalesce({x}, 0)::DOUBLE AS {x}" for x in MEANS)}, coalesce(avg_tokens_per_query, 0) AS avg_tokens_per_query,
  avg_len AS avg_chunk_length, CASE WHEN n_chunks > 1 THEN std_len ELSE 0 END AS chunk_length_std, ek AS effective_k,
  (tot + (SELECT sum(len(regexp_extract_all(question, '{TOKEN}'))) FROM q))::BIGINT AS total_embedding_tokens FROM st LEFT JOIN mm USING (config_id))"""


MEANS = [
    "token_iou", "token_precision", "token_recall", "recall_at_1", "recall_at_3", "recall_at_5", "mrr", "ndcg_at_1", "ndcg_at_3", "ndcg_at_5",
    "duplication_ratio",
]


def score(weights: dict[str, float]) -> str:
    return " + ".join(f"({w}) * {m}" for m, w in weights.items() if m in MEANS)


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def rounded(names: Iterable[str], places: int = 6) -> str:
    return ", ".join(f"round({n}::DOUBLE, {places}) AS {n}" for n in names)


def window(c: Config) -> tuple[str, int, int]:
    most = int(c.params.get("max_tokens", c.params.get("chunk_size_tokens", 512)))
    return c.id, most, most - int(c.params.get("overlap_tokens", 0))


def profiles(metrics: str = "al") -> str:
    return " UNION ALL ".join(f"SELECT config_id, {lit(u)} AS use_case, round({score(w)}, 6) AS score FROM {metrics}" for u, w in PROFILES.items())


def params(config_id: str) -> dict:
    return json.loads(config_id.partition(":")[2])
