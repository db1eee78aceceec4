"""SQL counterparts of the queries, as far as SQL can express them."""

from __future__ import annotations

from sparksync.llm.chat import MISTRAL_LIKE

#: SQL text of a lower-cased text and its words, for A-Z only.
LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _near(width: int, percent: int, docs: str) -> str:
    """(doc_id, n_shingles, component_id, kept) as common table expressions ending in ``near_out``."""
    return rf"""
near_words AS (
    SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM {docs}
),
near_sets AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END) AS g
    FROM near_words
),
near_sizes AS (SELECT doc_id, count(*) AS n FROM near_sets GROUP BY doc_id),
near_links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM near_sets a JOIN near_sets b ON a.g = b.g AND a.doc_id <> b.doc_id
    JOIN near_sizes x ON x.doc_id = a.doc_id JOIN near_sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))
),
near_reach AS (
    SELECT a, b FROM near_links UNION SELECT r.a, l.b FROM near_reach r JOIN near_links l ON r.b = l.a
),
near_out AS (
    SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, lo) AS component_id, doc_id = least(doc_id, lo) AS kept
    FROM {docs} LEFT JOIN near_sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS lo FROM near_reach GROUP BY a) USING (doc_id)
)"""


_ITEM_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH item_words AS (SELECT item_id, {_ITEM_WORDS.format(LOWER.format('text'))} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
),
doc_words AS (SELECT doc_id, {_ITEM_WORDS.format(LOWER.format('text'))} AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc_words WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM spots, lengths WHERE i + n - 1 <= len(w)),
hits AS (SELECT doc_id, i, windows.n, item_id FROM runs JOIN windows ON runs.g = windows.g AND runs.n = windows.n),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

def _escaped(text: str) -> str:
    """SQL for a text with doubled backslashes and broken control strings."""
    text = rf"replace(coalesce({text}, ''), '\', '\\')"
    for word in MISTRAL_LIKE.control():
        text = rf"replace({text}, '{word}', '{word[0]}\{word[1:]}')"
    return text


CHAT = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(k, r)
),
marked AS (
    SELECT *, {_escaped('text')} AS body, CASE role WHEN 'system' THEN '[SYS]' WHEN 'user' THEN '[INST]' WHEN 'assistant' THEN '[ANS]'
        ELSE '[ROLE]' || {_escaped('role')} || '[/ROLE]' END AS first,
        CASE role WHEN 'system' THEN '[/SYS]' WHEN 'user' THEN '[/INST]' WHEN 'assistant' THEN '</s>' ELSE '[/TURN]' END AS last
    FROM turns
),
joined AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body) AS said,
        coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (WHERE role = 'assistant'), '') AS learned,
        3 + sum(length(first) + length(body) + length(last)) AS formatted_chars
    FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""

ORACLES: dict[str, str] = {
    "op11_chat_formatting": CHAT,
    "op7_topk_search": TOP_K,
    "op9_benchmark_decontamination": DECONTAMINATION,
    "op4_minhash_near_dedup": f"WITH RECURSIVE {_near(3, 85, 'documents')} SELECT * FROM near_out",
}
