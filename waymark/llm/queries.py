"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .language_id import op1_language_id
from .license_scan import DEFAULT, PHRASES, op8_license_scan
from .mixing import op4_temperature_mixing
from .near_duplicates import op10_minhash_near_dedup
from .nearest_neighbours import op2_nn_descent
from .packing import op6_concat_and_cut
from .quality_model import op7_attention_quality
from .quality_rules import op5_quality_rules
from .secret_scan import op9_secret_scan
from .sharding import op3_label_propagation

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_nn_descent": op2_nn_descent,
    "op3_label_propagation": op3_label_propagation,
    "op4_temperature_mixing": op4_temperature_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_concat_and_cut": op6_concat_and_cut,
    "op7_attention_quality": op7_attention_quality,
    "op8_license_scan": op8_license_scan,
    "op9_secret_scan": op9_secret_scan,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _places(phrase: str) -> str:
    words = phrase.split()
    holds = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))
    return f"list_filter(range(0, greatest(len(w) - {len(words) - 1}, 0)), lambda i: {holds})"


_NEAR = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE
         list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b USING (g) WHERE a.doc_id != b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.c)
SELECT s.doc_id, CAST(any_value(len(s.s)) AS BIGINT) AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id
"""

_TEMPLATE_ROWS = ", ".join(f"({k}, '{t.label}', {_list(t.words)}, {t.need}, {t.span})" for k, t in enumerate(DEFAULT.each))
_WITHIN_ROWS = ", ".join(f"({a}, {b})" for a, b in DEFAULT.within)
_LICENSE = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
base AS (SELECT doc_id, w, {", ".join(f"{_places(p)} AS p{k}" for k, (p, _) in enumerate(PHRASES))} FROM words),
found AS (SELECT *, list_concat({", ".join(f"p{k}" for k in range(len(PHRASES)))}) AS starts_at,
  list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))}], lambda x: x IS NOT NULL) AS own FROM base),
templates(k, label, t, need, span) AS (VALUES {_TEMPLATE_ROWS}),
within_(a, b) AS (VALUES {_WITHIN_ROWS}),
at_ AS (SELECT doc_id, k, unnest(range(len(w))) AS i, w FROM words, templates WHERE len(list_intersect(t, w)) >= need),
ahead AS (SELECT doc_id, k, label, i, len(t) AS m, need, list_slice(w, i + 1, i + span) AS v, t FROM at_ JOIN templates USING (k) WHERE list_contains(t, w[i + 1])),
firsts AS (SELECT *, list_sort(list_transform(list_intersect(t, v), lambda x: list_position(v, x))) AS f FROM ahead),
met AS (SELECT doc_id, k, label, i AS lo, i + f[need] - 1 AS hi, len(f) / m AS share FROM firsts WHERE len(f) >= need),
meant AS (SELECT * FROM met m WHERE NOT EXISTS (
  SELECT 1 FROM within_ i JOIN met o ON o.k = i.b WHERE i.a = m.k AND o.doc_id = m.doc_id AND o.lo <= m.lo AND m.hi <= o.hi)),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM meant GROUP BY doc_id)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(starts_at) AS BIGINT) AS n_base, list_min(starts_at) AS first_word, list_max(starts_at) AS last_word,
  array_to_string(list_sort(list_distinct(own)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(own, coalesce(labels, [])))), ',') AS labels,
  CASE WHEN len(starts_at) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0) END AS score
FROM found s LEFT JOIN more USING (doc_id)
"""

ORACLES: dict[str, str] = {"op8_license_scan": _LICENSE, "op10_minhash_near_dedup": _NEAR}
