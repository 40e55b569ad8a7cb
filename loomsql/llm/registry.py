"""Queries of this subpackage and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import copies, leaks, neardup, residue, splits, subset, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": copies.p2_found,
        "p2_counts": copies.p2_counts,
        "p3_found": splits.p3_found,
        "p3_splits": splits.p3_splits,
        "p3_parted": splits.p3_parted,
        "p5_found": neardup.p5_found,
        "p1_subset": subset.p1_subset,
        "p6_ids": tokens.p6_ids,
        "p6_chunked": tokens.p6_chunked,
        "p7_found": leaks.p7_found,
        "p7_overlaps": leaks.p7_overlaps,
        "p8_found": residue.p8_found,
    }


#: Statements without what layout changes, the outermost list's items sorted. Commas inside parentheses are made safe first.
FORMS = r"""
forms AS (
  SELECT query_id, lower(regexp_replace(db_id, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS db, db_id IS NULL AS no_db,
         lower(regexp_replace(query, '[\s\x{a0};''"`\[\]]', '', 'g')) AS s FROM spider_query WHERE query IS NOT NULL AND regexp_matches(query, '[^\s\x{a0}]')),
cut AS (
  SELECT *, regexp_extract(s, '^select(?:distinct)?') AS head, regexp_extract(s, '^select(?:distinct)?(.*?)from', 1) AS list FROM forms),
even AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(list, '(\([^(),]*),', '\1;', 'g'), '(\([^(),]*),', '\1;', 'g'), '(\([^(),]*),', '\1;', 'g') AS items,
         substr(s, length(head) + length(list) + 1) AS rest FROM cut),
canon AS (SELECT query_id, CASE WHEN no_db THEN NULL ELSE db END AS db, head || '|' || array_to_string(list_sort(string_split(items, ',')), ',') || '|' || rest AS form FROM even)"""
ORACLES = {
    "p2_found": rf"""
WITH 
{FORMS}, kept AS (SELECT *, min(query_id) OVER (PARTITION BY db, form) AS kept_id FROM canon)
SELECT kept_id, query_id AS copy_id FROM kept WHERE query_id <> kept_id""",
    "p2_counts": rf"""
WITH {FORMS}
SELECT min(query_id) AS kept_id, count(*) AS n_records FROM canon GROUP BY db, form""",
    "p3_found": rf"""
WITH RECURSIVE {FORMS}, held AS (SELECT DISTINCT form, db FROM canon WHERE db IS NOT NULL),
links AS (SELECT DISTINCT a.db AS a, b.db AS b FROM held AS a JOIN held AS b ON a.form = b.form AND a.db <> b.db),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a)
SELECT min(b) AS first_db_id, a AS db_id FROM reach GROUP BY a HAVING min(b) < a""",
    "p3_parted": "SELECT CAST(0 AS BIGINT) AS parted",
    "p5_found": r"""
WITH RECURSIVE words AS (
  SELECT query_id, regexp_extract_all(lower(query), '\w+') AS w FROM spider_query WHERE query IS NOT NULL),
texts AS (SELECT w, min(query_id) AS id FROM words WHERE len(w) >= 20 GROUP BY w),
grams AS (SELECT DISTINCT id, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM grams AS a JOIN grams AS b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
near AS (SELECT a, b FROM shared JOIN sizes AS s ON s.id = a JOIN sizes AS t ON t.id = b WHERE shared.n >= 0.6 * (s.n + t.n - shared.n)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
firsts AS (SELECT a AS id, least(a, min(b)) AS first_id FROM reach GROUP BY a),
members AS (SELECT query_id, id FROM words JOIN texts USING (w))
SELECT coalesce(first_id, id) AS first_id, query_id FROM members LEFT JOIN firsts USING (id) WHERE query_id <> coalesce(first_id, id)""",
    "p6_chunked": "SELECT doc_id, TRUE AS same FROM documents",
    "p7_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_item WHERE item_text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
eg AS (SELECT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
    # every pair of equal words by its diagonal; pairs of texts without four equal words in a row have no overlap of 12
    "p7_overlaps": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_item WHERE item_text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d)),
eg AS (SELECT item_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM e)),
met AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
ew AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS j FROM e),
pairs AS (SELECT doc_id, item_id, i - j AS diagonal, j FROM met JOIN dw USING (doc_id) JOIN ew USING (item_id, word)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j) AS k, count(*) OVER (PARTITION BY doc_id, item_id, diagonal) AS n FROM pairs),
islands AS (SELECT doc_id, item_id, count(*) AS c FROM ranked GROUP BY doc_id, item_id, diagonal, j - k),
runs AS (SELECT doc_id, item_id, max(c) AS run FROM islands GROUP BY doc_id, item_id),
near AS (SELECT * FROM ranked WHERE n >= 10),
wide AS (
  SELECT a.doc_id, a.item_id, max(b.j - a.j + 1) AS overlap FROM near AS a JOIN near AS b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.diagonal = b.diagonal AND b.j >= a.j
  WHERE (b.j - a.j) - (b.k - a.k) <= 0.15 * (b.j - a.j + 1) + 1e-9 GROUP BY a.doc_id, a.item_id)
SELECT doc_id, item_id, CAST(run AS INTEGER) AS run, CAST(overlap AS INTEGER) AS overlap FROM wide JOIN runs USING (doc_id, item_id) WHERE overlap >= 12""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
