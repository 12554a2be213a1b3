"""SQL equivalents of the training-data queries that SQL can express."""

from __future__ import annotations

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _terms(text: str) -> str:
    """All runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return f"regexp_extract_all(translate({text}, {_CAPITALS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


_RANKED = f"""
WITH found AS (SELECT doc_id, unnest({_terms("text")}) AS term FROM documents),
counted AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM counted, totals GROUP BY term, n_docs),
asked AS (SELECT DISTINCT item_id, unnest({_terms("text")}) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
WHERE place <= 50"""

_WINDOW = 10
_CONTAMINATED = f"""
WITH docs AS MATERIALIZED (SELECT doc_id, {_terms("coalesce(text, '')")} AS words FROM documents),
items AS (SELECT item_id, {_terms("coalesce(text, '')")} AS words FROM benchmark),
starts AS (SELECT item_id, words, unnest(range(1, greatest(len(words) - {_WINDOW - 1}, 1) + 1)) AS i FROM items WHERE len(words) > 0),
phrases AS (SELECT DISTINCT item_id, least(len(words), {_WINDOW}) AS size, array_to_string(words[i:i + {_WINDOW - 1}], ' ') AS phrase FROM starts),
sizes AS (SELECT DISTINCT size FROM phrases),
places AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM docs),
runs AS (SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS phrase FROM places, sizes WHERE i + size - 1 <= len(words)),
hits AS MATERIALIZED (SELECT doc_id, i, size, item_id FROM runs JOIN phrases USING (size, phrase)),
hit_words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + size)) AS w FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""

_SQL: dict[str, str] = {
    "op11_stratified_search": _RANKED,
    "op13_fm_decontamination": _CONTAMINATED,
}


def all_sql() -> dict[str, str]:
    return dict(_SQL)
