"""Flat tables of the nested statements in ``sample_sqls``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import relation, statement_rows
from ..session import table
from .registry import query


def _rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Rows of the statements with the columns of these elements."""
    return statement_rows(table(spark, sf_dir, "sample_sqls"), frozenset(columns))


def _direction() -> F.Column:
    asc = F.lower(F.trim(F.col("columns")["asc"]))
    return F.when(asc.isin("true", "t"), "order_asc").when(asc.isin("false", "f"), "order_desc").otherwise("order_default")


#: The same rows from DuckDB's JSON tree, walked down by a recursive query.
FOUND = r"""
WITH RECURSIVE tree AS (
  SELECT sql_id, t.id AS id, t.parent AS parent, t.key AS key, t.type AS type, t.atom AS atom FROM (SELECT sql_id, ast_json FROM sample_sqls WHERE json_valid(ast_json)) AS d, json_tree(d.ast_json) AS t),
bodies AS (SELECT DISTINCT sql_id, parent AS id FROM tree WHERE key = 'body'),
directions AS (SELECT sql_id, parent AS id, CASE WHEN type = 'NULL' THEN NULL ELSE lower(trim(CAST(atom AS VARCHAR), '"')) END AS way FROM tree WHERE key = 'asc'),
marked AS (
  SELECT c.sql_id, c.id, c.parent, c.key, b.id IS NOT NULL AND c.type = 'OBJECT' AS is_query, p.type = 'ARRAY' AND p.key = 'cte_tables' AS is_cte, p.type = 'ARRAY' AND p.key = 'order_by' AS is_order,
         c.key = 'limit' AND c.type <> 'NULL' AND pb.id IS NOT NULL AND p.type = 'OBJECT' AS is_limit, w.way
  FROM tree AS c LEFT JOIN tree AS p ON p.sql_id = c.sql_id AND p.id = c.parent LEFT JOIN bodies AS b ON b.sql_id = c.sql_id AND b.id = c.id
  LEFT JOIN bodies AS pb ON pb.sql_id = c.sql_id AND pb.id = c.parent LEFT JOIN directions AS w ON w.sql_id = c.sql_id AND w.id = c.id),
placed AS (
  SELECT sql_id, id, '$' AS path, '' AS above, is_query, false AS is_cte, false AS is_order, false AS is_limit, way FROM marked WHERE parent IS NULL
  UNION ALL
  SELECT m.sql_id, m.id, p.path || '/' || m.key, CASE WHEN p.is_query OR p.is_cte OR p.is_order OR p.is_limit THEN p.path ELSE p.above END, m.is_query, m.is_cte, m.is_order, coalesce(m.is_limit, false), m.way
  FROM placed AS p JOIN marked AS m ON m.sql_id = p.sql_id AND m.parent = p.id)
SELECT sql_id, 'query' AS node_kind, path AS node_path, CASE WHEN is_cte OR is_order OR is_limit THEN path ELSE above END AS parent_path FROM placed WHERE is_query
UNION ALL SELECT sql_id, 'cte', path, above FROM placed WHERE is_cte
UNION ALL SELECT sql_id, CASE way WHEN 'true' THEN 'order_asc' WHEN 'false' THEN 'order_desc' ELSE 'order_default' END, path, above FROM placed WHERE is_order
UNION ALL SELECT sql_id, 'limit', path, above FROM placed WHERE is_limit"""


#: The same walk, with the values of the members that the flat tables have as columns.
VALUES = FOUND[: FOUND.index("SELECT sql_id, 'query'")].rstrip() + r""",
members AS (SELECT sql_id, parent AS id, key, CASE WHEN type = 'NULL' THEN NULL ELSE lower(trim(CAST(atom AS VARCHAR), '"')) END AS v FROM tree WHERE key = 'nulls_first'),
items AS (SELECT p.*, CAST(regexp_extract(p.path, '([0-9]+)$', 1) AS INTEGER) AS ordinal FROM placed AS p)
"""
SORT_ITEMS = VALUES + r"""
SELECT i.sql_id, i.path AS node_path, i.above AS parent_path, i.ordinal, CASE i.way WHEN 'true' THEN 'order_asc' WHEN 'false' THEN 'order_desc' ELSE 'order_default' END AS direction, m.v AS nulls_first
FROM items AS i LEFT JOIN members AS m ON m.sql_id = i.sql_id AND m.id = i.id WHERE i.is_order"""
CTES = VALUES + r"""
, step AS (SELECT sql_id, id, parent, key, type, atom FROM tree)
SELECT i.sql_id, i.path AS node_path, i.above AS parent_path, i.ordinal, CASE WHEN v.type IN ('NULL', 'OBJECT', 'ARRAY') THEN NULL ELSE json_extract_string(v.atom, '$') END AS cte_name
FROM items AS i LEFT JOIN step AS a ON a.sql_id = i.sql_id AND a.parent = i.id AND a.key = 'alias' LEFT JOIN step AS n ON n.sql_id = a.sql_id AND n.parent = a.id AND n.key = 'name'
LEFT JOIN step AS v ON v.sql_id = n.sql_id AND v.parent = n.id AND v.key = 'value' WHERE i.is_cte"""
GRAPH = r"""
WITH RECURSIVE tree AS (
  SELECT sql_id, t.id AS id, t.parent AS parent, t.key AS key, t.type AS type FROM (SELECT sql_id, ast_json FROM sample_sqls WHERE json_valid(ast_json)) AS d, json_tree(d.ast_json) AS t),
named AS (
  SELECT c.sql_id, c.id, c.parent, c.type, CASE WHEN c.parent IS NULL THEN 'root' WHEN p.type = 'ARRAY' THEN NULL ELSE c.key END AS own, p.type = 'ARRAY' AS in_array
  FROM tree AS c LEFT JOIN tree AS p ON p.sql_id = c.sql_id AND p.id = c.parent),
walk AS (
  SELECT sql_id, id, type, own AS label, type = 'OBJECT' AS element, false AS repeated, '' AS around, CASE WHEN type = 'OBJECT' THEN 'root' ELSE '' END AS inside FROM named WHERE parent IS NULL
  UNION ALL
  SELECT n.sql_id, n.id, n.type, CASE WHEN n.in_array THEN w.label ELSE n.own END, n.type <> 'ARRAY' AND (n.in_array OR n.type = 'OBJECT'), n.in_array, w.inside,
         CASE WHEN n.type <> 'ARRAY' AND (n.in_array OR n.type = 'OBJECT') THEN CASE WHEN n.in_array THEN w.label ELSE n.own END ELSE w.inside END
  FROM walk AS w JOIN named AS n ON n.sql_id = w.sql_id AND n.parent = w.id)
SELECT around AS parent, label AS child, bool_or(repeated) AS repeated, count(*) AS n FROM walk WHERE element GROUP BY around, label"""


@query("p4_found", FOUND)
def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "order")
    # One pass: the rows of a table and what is inlined in them come out of the same row.
    own = F.when(F.col("relation") == "order", _direction()).otherwise(F.col("relation"))
    inner = F.transform(F.map_entries("inlined"), lambda e: F.struct(e["key"].alias("kind"), F.split_part(e["value"], F.lit("\n"), F.lit(1)).alias("path"), F.col("node_path").alias("parent")))
    nodes = F.concat(F.array(F.struct(own.alias("kind"), F.col("node_path").alias("path"), F.col("parent_path").alias("parent"))), inner)
    out = rows.select("record_id", F.explode(nodes).alias("n"))
    return out.select(F.col("record_id").alias("sql_id"), F.col("n.kind").alias("node_kind"), F.col("n.path").alias("node_path"), F.col("n.parent").alias("parent_path"))


@query("p4_sort_items", SORT_ITEMS)
def sort_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(_rows(spark, sf_dir, "order"), "order")
    return rows.select(F.col("record_id").alias("sql_id"), "node_path", "parent_path", "ordinal", _direction().alias("direction"), F.lower(F.col("columns")["nulls_first"]).alias("nulls_first"))


@query("p4_limits")
def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(_rows(spark, sf_dir, "limit"), "limit")
    return rows.select(F.col("record_id").alias("sql_id"), "node_path", "parent_path", F.col("columns")["value"].alias("limit_json"))


@query("p4_ctes", CTES)
def ctes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(_rows(spark, sf_dir, "cte"), "cte")
    return rows.select(F.col("record_id").alias("sql_id"), "node_path", "parent_path", "ordinal", F.col("columns")["alias.name.value"].alias("cte_name"))


@query("p4_schema_graph", GRAPH)
def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which element names occur under which, over all members of all records."""
    from ..operators.nested import schema_graph

    return schema_graph(table(spark, sf_dir, "sample_sqls"), "ast_json")
