"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .chat_format import _ESCAPE, OTHER_FOOTER, ROLES
from .license_scan import TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(table: str, key: str, pattern: str, name: str = "w") -> str:
    return f"{name} AS (SELECT {key}, regexp_extract_all({_LOWER}, '{pattern}') AS w FROM {table})"


_BLANKS, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH RECURSIVE {_words("documents", "doc_id", _BLANKS)},
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(k.k, 0) AS n_links FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c LEFT JOIN n ON n.doc_id = c.doc_id LEFT JOIN (SELECT a, count(*) AS k FROM e GROUP BY 1) k ON k.a = c.doc_id
"""

OP2 = f"""
WITH {_words("documents", "doc_id", _BLANKS)},
v AS (SELECT doc_id, i - 1 AS place, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
k AS (SELECT doc_id, place, count(*) OVER (PARTITION BY s) AS c, row_number() OVER (PARTITION BY s ORDER BY doc_id, place) AS r FROM v),
x AS (SELECT doc_id, word, bool_and(first) AS kept FROM (SELECT doc_id, r = 1 AS first, unnest(range(place, place + 50)) AS word FROM k WHERE c > 1) GROUP BY 1, 2),
y AS (SELECT doc_id, word, kept, word - row_number() OVER (PARTITION BY doc_id, kept ORDER BY word) AS run FROM x)
SELECT doc_id, min(word) AS start_word, max(word) + 1 AS end_word, kept FROM y GROUP BY doc_id, kept, run
"""

OP4 = """
WITH RECURSIVE x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
r(a, b) AS (SELECT vec_id, vec_id FROM x UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) n ON n.a = c.vec_id
"""

_HEADS = " ".join(f"WHEN role = '{role}' THEN {len(head) + len(foot)}" for role, (head, foot) in ROLES.items())

OP5 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, CASE {_HEADS} ELSE length(url_encode(role)) + {len("[ROLE:] ") + len(OTHER_FOOTER)} END + length(regexp_replace(text, {_quoted(_ESCAPE)}, '\\1\\2\\\\\\3', 'g')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM s GROUP BY 1
"""

OP7 = f"""
WITH {_words("documents", "doc_id", _ALNUM)}, {_words("benchmark", "item_id", _ALNUM, "b")},
q AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS size, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
h AS (SELECT doc_id, place, size, item FROM (SELECT doc_id, i - 1 AS place, z.size, array_to_string(w[i:i + z.size - 1], ' ') AS s FROM (SELECT DISTINCT size FROM q) z, (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) d WHERE i + z.size - 1 <= len(w)) d JOIN q USING (s, size)),
k AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + size)) AS word FROM h) GROUP BY 1),
m AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
"""

_ROWS = ", ".join(f"({k}, {_quoted(t.label)}, {_quoted(t.text)}, {t.threshold}, {str(t.phrase).lower()})" for k, t in enumerate(TEMPLATES))

OP10 = f"""
WITH {_words("documents", "doc_id", _ALNUM)},
z AS (SELECT label, phrase, t, len(t) AS width, list_distinct(t) AS own, greatest(1, ceil(threshold * len(list_distinct(t)) - 1e-9)) AS needed FROM (SELECT *, regexp_extract_all({_LOWER}, '{_ALNUM}') AS t FROM (VALUES {_ROWS}) v(k, label, text, threshold, phrase))),
c AS (SELECT doc_id, label, phrase, needed, width, own, t, i, w[i:i + width - 1] AS block FROM (SELECT doc_id, w, z.label, z.phrase, z.needed, z.own, z.t, CASE WHEN phrase THEN z.width ELSE least(z.width, len(w)) END AS width, unnest(range(1, len(w) - CASE WHEN phrase THEN z.width ELSE least(z.width, len(w)) END + 2)) AS i FROM w, z WHERE len(w) > 0 AND list_has_any(w, own))),
h AS (SELECT doc_id, label, phrase, i - 1 AS place, CASE WHEN phrase THEN 1.0 ELSE len(list_intersect(list_distinct(block), own)) / len(own)::DOUBLE END AS part FROM c WHERE CASE WHEN phrase THEN block = t ELSE len(list_intersect(list_distinct(block), own)) >= needed END),
a AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(place) FILTER (phrase) AS first_word, max(place) FILTER (phrase) AS last_word, array_to_string(list_sort(list(DISTINCT label) FILTER (phrase)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(part) AS score FROM h GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM w LEFT JOIN a ON a.doc_id = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1, "op2_suffix_dedup": OP2, "op4_embedding_near_dedup": OP4, "op5_chat_format": OP5, "op7_decontamination": OP7, "op10_license_scan": OP10}
