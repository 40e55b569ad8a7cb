"""One query for each construct of the dialect, run through the engine over whole tables.

Each entry is (name, text) or (name, text, oracle): the text is the dialect's, the oracle is what DuckDB runs where its
spelling or a default of its own differs. The tables hold no nulls, so nullif() brings them in.
"""

from __future__ import annotations

from ..dialect.engine import run
from .registry import query

CONSTRUCTS: list[tuple[str, ...]] = [
    # scans and projection
    ("scan_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    ("scan_alias_renames", "SELECT a, b, n_regionkey FROM nation AS t (a, b) WHERE a > 3"),
    ("derived_table", "SELECT k, n FROM (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) AS d (k, n) WHERE n > 5"),
    ("derived_partial_renames", "SELECT k, total FROM (SELECT o_custkey, count(*) AS total FROM orders GROUP BY o_custkey) AS d (k)"),
    ("select_star", "SELECT * FROM region"),
    ("select_qualified_star", "SELECT r.*, n.n_name FROM nation AS n, region AS r WHERE n.n_regionkey = r.r_regionkey"),
    ("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    ("auto_alias", "SELECT count(*), max(c_acctbal), min(c_name) FROM customer", "SELECT count(*) AS count, max(c_acctbal) AS max, min(c_name) AS min FROM customer"),
    ("auto_alias_case", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS \"case\" FROM customer"),
    ("auto_alias_else", "SELECT CASE WHEN c_acctbal > 0 THEN 'x' ELSE c_name END FROM customer", "SELECT CASE WHEN c_acctbal > 0 THEN 'x' ELSE c_name END AS c_name FROM customer"),
    ("from_less", "SELECT 1 AS one, 'a' AS a, 2.5 > 1 AS yes"),
    ("nested_parentheses", "SELECT ((n_nationkey + 1) * (2 + (n_regionkey))) AS v FROM nation"),
    # predicates
    ("where_3vl", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') = 'O' OR NOT (nullif(o_orderpriority, '1-URGENT') > '2')"),
    ("value_3vl", "SELECT o_orderkey, (nullif(o_orderstatus, 'F') = 'O') AND (o_totalprice > 1000) AS a, (nullif(o_orderstatus, 'F') = 'O') OR (o_totalprice > 1000) AS b, NOT (nullif(o_orderstatus, 'F') = 'O') AS c FROM orders"),
    ("is_null", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') IS NULL"),
    ("is_not_null", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') IS NOT NULL"),
    ("is_bool", "SELECT o_orderkey, (nullif(o_orderstatus, 'F') = 'O') IS TRUE AS t, (nullif(o_orderstatus, 'F') = 'O') IS NOT FALSE AS nf, (nullif(o_orderstatus, 'F') = 'O') IS UNKNOWN AS u FROM orders",
     "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F') = 'O', false) AS t, coalesce(nullif(o_orderstatus, 'F') = 'O', true) AS nf, (nullif(o_orderstatus, 'F') = 'O') IS NULL AS u FROM orders"),
    ("is_distinct_from", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') IS DISTINCT FROM nullif(o_orderstatus, 'P')"),
    ("is_not_distinct_from", "SELECT o_orderkey, nullif(o_orderstatus, 'O') IS NOT DISTINCT FROM NULL AS v FROM orders"),
    ("exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    ("not_exists", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    ("exists_value", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has FROM orders"),
    ("in_list", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3, n_nationkey)"),
    ("not_in_list", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, 3)"),
    ("in_list_null", "SELECT n_name, nullif(n_regionkey, 1) IN (2, 3) AS a, n_regionkey NOT IN (2, NULL) AS b FROM nation"),
    ("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    ("not_in_subquery", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    ("not_in_subquery_null", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT nullif(n_regionkey, 2) FROM nation)"),
    ("in_subquery_value_3vl", "SELECT n_nationkey, n_nationkey IN (SELECT nullif(n_regionkey, 2) FROM nation) AS v, n_nationkey NOT IN (SELECT nullif(n_regionkey, 2) FROM nation) AS w FROM nation"),
    ("in_subquery_is_null", "SELECT n_name FROM nation WHERE (n_nationkey NOT IN (SELECT nullif(n_regionkey, 2) FROM nation)) IS NULL"),
    ("in_subquery_empty", "SELECT n_nationkey, nullif(n_nationkey, 3) IN (SELECT n_regionkey FROM nation WHERE n_regionkey > 99) AS v FROM nation"),
    ("between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000"),
    ("not_between", "SELECT o_orderkey FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 400000"),
    *((f"cmp_{n}", f"SELECT o_orderkey, nullif(o_orderstatus, 'P') {op} 'O' AS v FROM orders WHERE o_orderkey {op} o_custkey") for n, op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))),
    *((f"any_{n}", f"SELECT n_nationkey, nullif(n_nationkey, 7) {op} ANY (SELECT nullif(n_regionkey, 2) FROM nation) AS v, n_nationkey {op} ANY (SELECT n_regionkey FROM nation WHERE n_regionkey < 0) AS e FROM nation") for n, op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))),
    *((f"all_{n}", f"SELECT n_nationkey, nullif(n_nationkey, 7) {op} ALL (SELECT n_regionkey FROM nation WHERE n_regionkey > 1) AS v, n_nationkey {op} ALL (SELECT nullif(n_regionkey, 2) FROM nation) AS w, n_nationkey {op} ALL (SELECT n_regionkey FROM nation WHERE n_regionkey < 0) AS e FROM nation") for n, op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))),
    ("any_in_where", "SELECT o_orderkey FROM orders WHERE o_custkey = ANY (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"),
    ("all_in_where", "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT c_acctbal FROM customer)"),
    ("ne_all_in_where", "SELECT o_orderkey FROM orders WHERE o_orderkey <> ALL (SELECT l_orderkey FROM lineitem)"),
    ("quantified_correlated", "SELECT s_suppkey, s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = s_nationkey) AS v FROM supplier"),
    ("like", "SELECT p_partkey FROM part WHERE p_name LIKE '%1%' AND p_type LIKE 'PR_MO%'"),
    ("not_like", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%1%'"),
    ("and_or_not", "SELECT p_partkey FROM part WHERE NOT (p_size > 10 AND p_size < 40 OR p_retailprice > 1500) AND p_partkey > 0"),
    # joins
    ("cross_join", "SELECT n_name, r_name FROM nation CROSS JOIN region"),
    ("comma_join", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey"),
    ("inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    ("left_join", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45"),
    ("right_join", "SELECT o_orderkey, l_linenumber FROM lineitem RIGHT JOIN orders ON o_orderkey = l_orderkey AND l_quantity < 5"),
    ("full_join", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation AS a FULL JOIN region AS b ON a.n_nationkey = b.r_regionkey + 2"),
    ("full_join_theta", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation AS a FULL JOIN region AS b ON a.n_nationkey < b.r_regionkey - 2"),
    ("theta_join", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    ("self_join", "SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer AS a JOIN customer AS b ON a.c_custkey = b.c_custkey + 1"),
    ("join_using", "SELECT * FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) AS a JOIN (SELECT c_custkey AS k, c_name FROM customer) AS b USING (k)"),
    ("join_using_left", "SELECT k, n, m FROM (SELECT n_nationkey AS k, n_name AS n FROM nation) AS a LEFT JOIN (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY s_nationkey) AS b USING (k)"),
    ("join_chain", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"),
    ("join_mixed", "SELECT r_name, n_name, s_name FROM region, nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE r_regionkey = n_regionkey"),
    ("join_on_subquery", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 3)"),
    ("semi_join", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)"),
    ("anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)"),
    # grouping
    ("group_by", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority"),
    ("group_by_null", "SELECT nullif(o_orderstatus, 'F') AS s, count(*) AS n FROM orders GROUP BY nullif(o_orderstatus, 'F')"),
    ("group_single", "SELECT count(*) AS n, max(o_orderkey) AS m FROM orders GROUP BY ()", "SELECT count(*) AS n, max(o_orderkey) AS m FROM orders"),
    ("group_single_plain", "SELECT 1 AS one FROM orders GROUP BY ()", "SELECT 1 AS one"),
    ("group_by_true_empty", "SELECT true AS yes FROM orders WHERE o_orderkey < 0 GROUP BY true"),
    ("having_without_group", "SELECT count(*) AS n FROM orders HAVING count(*) > 3"),
    ("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    ("grouping_sets_empty_dup", "SELECT count(*) AS n FROM orders GROUP BY GROUPING SETS ((), (), ())", "SELECT count(*) AS n FROM orders UNION ALL SELECT count(*) FROM orders UNION ALL SELECT count(*) FROM orders"),
    ("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    ("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    ("mixed_grouping", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_returnflag, GROUPING SETS ((l_linestatus), ()), CUBE (l_linenumber)"),
    ("composite_sets", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ROLLUP ((l_returnflag, l_linestatus), l_linenumber)"),
    ("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) < 200000"),
    ("pk_functional_dep", "SELECT c_custkey, c_name, c_nationkey + 1 AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
     "SELECT c_custkey, any_value(c_name) AS c_name, any_value(c_nationkey) + 1 AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    ("group_by_position", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1"),
    # order and limit
    ("order_alias", "SELECT o_custkey AS k, o_orderkey FROM orders ORDER BY k, o_orderkey LIMIT 20"),
    ("order_expr", "SELECT o_orderkey FROM orders ORDER BY o_totalprice * -1, o_orderkey LIMIT 20"),
    ("order_position", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 15"),
    ("order_nulls_first", "SELECT nullif(o_orderstatus, 'F') AS s, o_orderkey FROM orders ORDER BY s NULLS FIRST, o_orderkey LIMIT 25"),
    ("order_nulls_last", "SELECT nullif(o_orderstatus, 'F') AS s, o_orderkey FROM orders ORDER BY s DESC NULLS LAST, o_orderkey LIMIT 25"),
    ("order_default_nulls_asc", "SELECT nullif(n_regionkey, 2) AS s, n_nationkey FROM nation ORDER BY s, n_nationkey LIMIT 8", "SELECT nullif(n_regionkey, 2) AS s, n_nationkey FROM nation ORDER BY s ASC NULLS LAST, n_nationkey LIMIT 8"),
    ("order_default_nulls_desc", "SELECT nullif(n_regionkey, 2) AS s, n_nationkey FROM nation ORDER BY s DESC, n_nationkey LIMIT 8", "SELECT nullif(n_regionkey, 2) AS s, n_nationkey FROM nation ORDER BY s DESC NULLS FIRST, n_nationkey LIMIT 8"),
    ("limit_one", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1"),
    ("limit_n", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 17"),
    ("limit_expression", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 2 + 3"),
    ("limit_subquery", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT count(*) FROM region)"),
    ("offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10"),
    ("top_k", "SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey ORDER BY q DESC, l_partkey LIMIT 10"),
    # set operations
    ("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    ("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    ("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    ("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    ("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT n_regionkey FROM nation"),
    ("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    ("setop_precedence", "SELECT n_nationkey AS k FROM nation UNION SELECT n_nationkey + 100 FROM nation INTERSECT SELECT n_nationkey + 110 FROM nation EXCEPT SELECT n_regionkey FROM nation"),
    ("setop_widening", "SELECT n_nationkey AS k FROM nation UNION SELECT 3000000000 UNION SELECT c_custkey FROM customer"),
    ("setop_parenthesised", "(SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey DESC LIMIT 3) UNION (SELECT n_regionkey FROM nation EXCEPT SELECT 1)"),
    ("setop_order", "SELECT n_nationkey AS k FROM nation UNION SELECT 77 ORDER BY k DESC LIMIT 4"),
    ("setop_nulls", "SELECT nullif(n_regionkey, 1) AS k FROM nation INTERSECT SELECT nullif(n_regionkey, 2) FROM nation"),
    # subqueries
    ("scalar_subquery", "SELECT n_name, (SELECT max(c_acctbal) FROM customer) AS top FROM nation"),
    ("scalar_limit_one", "SELECT n_name, (SELECT r_name FROM region ORDER BY r_name LIMIT 1) AS first_region FROM nation"),
    ("scalar_correlated", "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation"),
    ("scalar_correlated_null", "SELECT n_name, (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS m FROM nation"),
    ("scalar_in_where", "SELECT c_custkey FROM customer AS c WHERE c_acctbal > (SELECT avg(c_acctbal) + 4000 FROM customer AS d WHERE d.c_nationkey = c.c_nationkey)"),
    ("scalar_in_group", "SELECT n_regionkey, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS r, count(*) AS n FROM nation GROUP BY n_regionkey"),
    ("scalar_in_order", "SELECT n_name FROM nation ORDER BY (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) DESC, n_name LIMIT 9"),
    ("subquery_in_having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > (SELECT count(*) / 25 FROM customer)", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > (SELECT count(*) // 25 FROM customer)"),
    ("deep_correlation", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal * 20 > o_totalprice))"),
    ("deep_not_exists", "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > c_acctbal - 9000))"),
    ("deep_scalar", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > (SELECT avg(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey OR s_nationkey = n_regionkey)) AS v FROM nation"),
    ("deep_in", "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 = r_regionkey))"),
    ("mixed_outer_agg", "SELECT n_nationkey, (SELECT max(s_suppkey + n_regionkey) FROM supplier WHERE s_nationkey = n_nationkey) AS v FROM nation"),
    ("lateral_join", "SELECT n_name, m FROM nation, LATERAL (SELECT max(c_acctbal) AS m FROM customer WHERE c_nationkey = n_nationkey) AS x"),
    # numbers
    ("arith", "SELECT o_orderkey, o_orderkey + o_custkey AS a, o_orderkey - o_custkey AS b, o_orderkey * 3 AS c, -o_orderkey AS d, +o_orderkey AS e, o_orderkey % 7 AS f FROM orders"),
    ("int_div", "SELECT o_orderkey, o_orderkey / 7 AS a, -o_orderkey / 7 AS b FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS a, -(o_orderkey // 7) AS b FROM orders"),
    ("double_div", "SELECT o_orderkey, round(o_totalprice / 7, 6) AS a FROM orders"),
    ("bit_ops", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 5 AS b, ~o_orderkey AS c FROM orders"),
    ("bit_xor_op", "SELECT o_orderkey, o_orderkey # 13 AS a FROM orders", "SELECT o_orderkey, xor(o_orderkey, 13) AS a FROM orders"),
    ("power", "SELECT n_nationkey, 2 ^ n_nationkey AS a, n_nationkey ^ 3 AS b FROM nation", "SELECT n_nationkey, pow(2, n_nationkey) AS a, pow(n_nationkey, 3) AS b FROM nation"),
    ("abs", "SELECT c_custkey, @c_acctbal AS a FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a FROM customer"),
    ("cbrt", "SELECT n_nationkey, round(||/n_nationkey, 9) AS a FROM nation", "SELECT n_nationkey, round(cbrt(n_nationkey), 9) AS a FROM nation"),
    ("sqrt", "SELECT n_nationkey, round(|/n_nationkey, 9) AS a FROM nation", "SELECT n_nationkey, round(sqrt(n_nationkey), 9) AS a FROM nation"),
    ("position", "SELECT p_partkey, position('A' IN p_type) AS a, position('' IN p_type) AS b, position(nullif('x', 'x') IN p_type) AS c FROM part", "SELECT p_partkey, CAST(position('A' IN p_type) AS INT) AS a, 1 AS b, CAST(NULL AS INT) AS c FROM part"),
    *((f"extract_{f}", f"SELECT event_id, CAST(extract({f} FROM ts) AS bigint) AS a FROM events", f"SELECT event_id, CAST({d} AS BIGINT) AS a FROM events")
      for f, d in ((f, f"extract({f} FROM ts)") for f in ("minute", "hour", "day", "week", "month", "quarter", "year", "isodow", "isoyear", "decade", "century", "millennium", "dow", "doy"))),
    ("extract_second", "SELECT event_id, CAST(extract(second FROM ts) * 1000000 AS bigint) AS a FROM events", "SELECT event_id, extract(microseconds FROM ts) % 60000000 AS a FROM events"),
    ("extract_milliseconds", "SELECT event_id, CAST(extract(milliseconds FROM ts) * 1000 AS bigint) AS a FROM events", "SELECT event_id, extract(microseconds FROM ts) % 60000000 AS a FROM events"),
    ("extract_microseconds", "SELECT event_id, CAST(extract(microseconds FROM ts) AS bigint) AS a FROM events", "SELECT event_id, extract(microseconds FROM ts) % 60000000 AS a FROM events"),
    ("extract_date", "SELECT o_orderkey, CAST(extract(year FROM CAST(o_orderdate AS date)) AS bigint) AS y, CAST(extract(hour FROM CAST(o_orderdate AS date)) AS bigint) AS h FROM orders", "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, 0::BIGINT AS h FROM orders"),
    ("extract_interval", "SELECT event_id, CAST(extract(day FROM ts - TIMESTAMP '2020-01-01 00:00:00') AS bigint) AS d, CAST(extract(hour FROM ts - TIMESTAMP '2020-01-01 00:00:00') AS bigint) AS h FROM events"),
    # text
    ("trim_both", "SELECT p_partkey, trim(BOTH 'P' FROM p_type) AS a, trim(p_name) AS b FROM part", "SELECT p_partkey, trim(p_type, 'P') AS a, trim(p_name) AS b FROM part"),
    ("trim_leading", "SELECT p_partkey, trim(LEADING 'PR' FROM p_type) AS a FROM part", "SELECT p_partkey, ltrim(p_type, 'PR') AS a FROM part"),
    ("trim_trailing", "SELECT p_partkey, trim(TRAILING 'OM' FROM p_type) AS a FROM part", "SELECT p_partkey, rtrim(p_type, 'OM') AS a FROM part"),
    ("concat", "SELECT p_partkey, p_brand || '/' || p_type AS a, p_brand || nullif(p_type, 'PROMO') AS b FROM part"),
    ("substring_from_for", "SELECT p_partkey, substring(p_type FROM 2 FOR 3) AS a FROM part"),
    ("substring_from", "SELECT p_partkey, substring(p_type FROM 3) AS a FROM part"),
    ("substring_for", "SELECT p_partkey, substring(p_type FOR 2) AS a FROM part", "SELECT p_partkey, substring(p_type, 1, 2) AS a FROM part"),
    ("substring_edges", "SELECT n_nationkey, substring(n_name FROM 0 FOR 3) AS a, substring(n_name FROM -1 FOR 3) AS b, substring(n_name FROM 50) AS c, substring(n_name FROM -5) AS d, substring(n_name FROM 2 FOR 0) AS e, substring(n_name FROM nullif(1, 1) FOR 2) AS f FROM nation",
     "SELECT n_nationkey, substring(n_name, 1, 2) AS a, substring(n_name, 1, 1) AS b, '' AS c, n_name AS d, '' AS e, CAST(NULL AS VARCHAR) AS f FROM nation"),
    # dates and intervals
    ("date_plus_int", "SELECT o_orderkey, CAST(o_orderdate AS date) + 10 AS d FROM orders"),
    ("int_plus_date", "SELECT o_orderkey, 10 + CAST(o_orderdate AS date) AS d FROM orders"),
    ("date_minus_int", "SELECT o_orderkey, CAST(o_orderdate AS date) - 10 AS d FROM orders"),
    ("date_minus_date", "SELECT o_orderkey, CAST(o_orderdate AS date) - DATE '1995-01-01' AS d FROM orders"),
    ("date_plus_interval", "SELECT o_orderkey, CAST(o_orderdate AS date) + INTERVAL '1' day AS d, CAST(o_orderdate AS date) - INTERVAL '3' month AS e FROM orders"),
    ("interval_plus_date", "SELECT o_orderkey, INTERVAL '2' day + CAST(o_orderdate AS date) AS d FROM orders"),
    ("ts_plus_interval", "SELECT event_id, ts + INTERVAL '90' minute AS a, ts - INTERVAL '1' week AS b FROM events", "SELECT event_id, ts + INTERVAL 90 MINUTE AS a, ts - INTERVAL 7 DAY AS b FROM events"),
    ("ts_minus_ts", "SELECT event_id, ts - TIMESTAMP '2020-01-01 00:00:00' > INTERVAL '1500' day AS a FROM events"),
    ("interval_compound", "SELECT event_id, ts + INTERVAL '1 day 02:30:00' AS a, ts - INTERVAL '2 hours 15 minutes' AS b, ts + INTERVAL '1 year 2 months' AS c FROM events"),
    ("select_top", "SELECT TOP 5 o_orderkey FROM orders ORDER BY o_orderkey DESC", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5"),
    ("date_plus_days", "SELECT o_orderkey, CAST(o_orderdate AS date) + 14 days AS d FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS date) + INTERVAL 14 DAY AS d FROM orders"),
    ("interval_arith", "SELECT event_id, ts + (INTERVAL '1' day - INTERVAL '2' hour + INTERVAL '30' minute) AS a FROM events"),
    ("interval_neg", "SELECT event_id, ts + (-INTERVAL '36' hour) AS a FROM events", "SELECT event_id, ts - INTERVAL 36 HOUR AS a FROM events"),
    ("interval_agg", "SELECT event_type, CAST('2000-01-01 00:00:00' AS timestamp) + max(ts - TIMESTAMP '2020-01-01 00:00:00') AS mx, CAST('2000-01-01 00:00:00' AS timestamp) + min(ts - TIMESTAMP '2020-01-01 00:00:00') AS mn FROM events GROUP BY event_type",
     "SELECT event_type, TIMESTAMP '2000-01-01 00:00:00' + (max(ts) - TIMESTAMP '2020-01-01 00:00:00') AS mx, TIMESTAMP '2000-01-01 00:00:00' + (min(ts) - TIMESTAMP '2020-01-01 00:00:00') AS mn FROM events GROUP BY event_type"),
    # conditional, casts, literals
    ("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS a, CASE nullif(o_orderstatus, 'F') WHEN 'O' THEN 1 END AS b FROM orders"),
    ("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' END AS a FROM orders"),
    ("typed_null", "SELECT n_nationkey, CAST(NULL AS int) AS a, CAST(NULL AS text) AS b, CAST(NULL AS date) AS c, CAST(NULL AS boolean) AS d, CAST(NULL AS bigint) AS e FROM nation"),
    ("untyped_null", "SELECT n_nationkey FROM nation WHERE NULL IS NULL AND (NULL = 1) IS NULL"),
    ("literal_cast", "SELECT n_nationkey, CAST(5 AS bigint) AS a, CAST('2001-02-03' AS date) AS b, CAST('7' AS int) AS c FROM nation"),
    ("cast_rounds", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS bigint) AS a, CAST(l_discount * 100 AS int) AS b FROM lineitem"),
    ("literals", "SELECT true AS a, false AS b, 5 AS c, 3000000000 AS d, 'it''s' AS e, DATE '2001-02-03' AS f, TIMESTAMP '2001-02-03 04:05:06' AS g, 2.5 = 2.50 AS h"),
    # texts in quotes take the type of what they stand beside
    ("literal_date_cmp", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS date) >= '1998-01-01' AND o_orderdate < '1998-07-01' AND CAST(o_orderdate AS date) BETWEEN '1998-02-01' AND '1998-05-31' AND o_orderkey > '100' AND o_totalprice > '1000.5'"),
    ("literal_in", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS date) IN ('1998-01-02', '1998-03-04', '1999-05-06') OR o_orderkey IN ('7', '32') OR o_orderkey = ANY (SELECT n_nationkey FROM nation) AND '5' NOT IN (SELECT n_nationkey FROM nation)",
     "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS date) IN ('1998-01-02', '1998-03-04', '1999-05-06') OR o_orderkey IN (7, 32) OR o_orderkey IN (SELECT n_nationkey FROM nation) AND 5 NOT IN (SELECT n_nationkey FROM nation)"),
    ("literal_case", "SELECT n_nationkey, CASE n_regionkey WHEN '1' THEN 10 WHEN '2' THEN '20' ELSE '30' END AS a, coalesce(nullif(n_regionkey, '3'), '-1') AS b, greatest(n_nationkey, '12') AS c FROM nation",
     "SELECT n_nationkey, CASE n_regionkey WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 30 END AS a, coalesce(nullif(n_regionkey, 3), -1) AS b, greatest(n_nationkey, 12) AS c FROM nation"),
    ("literal_union", "SELECT CAST(o_orderdate AS date) AS d, o_orderkey AS k FROM orders WHERE o_orderkey < 50 UNION SELECT '1990-01-01', '5' FROM region",
     "SELECT CAST(o_orderdate AS date) AS d, o_orderkey AS k FROM orders WHERE o_orderkey < 50 UNION SELECT DATE '1990-01-01', 5 FROM region"),
    ("extract_interval_ym", "SELECT n_nationkey, extract(year FROM INTERVAL '14' month) AS y, extract(month FROM INTERVAL '14' month) AS m, extract(quarter FROM INTERVAL '14' month) AS q, extract(decade FROM INTERVAL '25' year) AS d, extract(month FROM INTERVAL '40' day) AS z, extract(quarter FROM INTERVAL '40' day) AS u, extract(year FROM -INTERVAL '14' month) AS w, extract(day FROM CASE WHEN n_nationkey > 5 THEN INTERVAL '3' month END) AS v FROM nation",
     "SELECT n_nationkey, 1 AS y, 2 AS m, 1 AS q, 2 AS d, 0 AS z, 1 AS u, -1 AS w, CASE WHEN n_nationkey > 5 THEN 0 END AS v FROM nation"),
    ("rollup_empty", "SELECT n_regionkey, n_name, count(*) AS n, sum(n_nationkey) AS s, grouping(n_name) AS g FROM nation WHERE n_nationkey < 0 GROUP BY ROLLUP (n_regionkey, n_name)",
     "SELECT CAST(NULL AS INTEGER) AS n_regionkey, CAST(NULL AS VARCHAR) AS n_name, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS s, 1 AS g"),
    ("cube_empty", "SELECT n_regionkey + 1 AS a, n_name || 'x' AS b, count(*) + 1 AS n FROM nation WHERE n_nationkey < 0 GROUP BY CUBE (n_regionkey, n_name)",
     "SELECT CAST(NULL AS INTEGER) AS a, CAST(NULL AS VARCHAR) AS b, CAST(1 AS BIGINT) AS n"),
    ("sets_empty", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey < 0 GROUP BY GROUPING SETS ((n_regionkey), (), ()) ORDER BY n",
     "SELECT CAST(NULL AS INTEGER) AS n_regionkey, CAST(0 AS BIGINT) AS n FROM range(2)"),
    ("totals_having_empty", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey < 0 GROUP BY ROLLUP (n_regionkey) HAVING count(*) = 0 AND n_regionkey IS NULL",
     "SELECT CAST(NULL AS INTEGER) AS n_regionkey, CAST(0 AS BIGINT) AS n"),
    ("quoted_table", 'SELECT "n_name" FROM "nation"'),
    ("not_in_nulls", "SELECT n_nationkey FROM nation WHERE nullif(n_nationkey, 3) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 1) AND n_nationkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 99)"),
    ("not_in_null_inside", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 2) FROM region)"),
    # what only the workloads use
    ("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey AS k FROM big WHERE s > 2000000) SELECT c_name FROM customer JOIN top ON c_custkey = k"),
    ("cte_reused", "WITH m (k, n) AS (SELECT c_nationkey, count(*) FROM customer GROUP BY c_nationkey) SELECT a.k AS k, b.n AS n FROM m AS a JOIN m AS b ON a.k = b.k + 1"),
    ("rank_over", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r, dense_rank() OVER (ORDER BY c_nationkey) AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer"),
    ("window_nulls", "SELECT n_nationkey, rank() OVER (ORDER BY nullif(n_regionkey, 2) DESC) AS r FROM nation", "SELECT n_nationkey, rank() OVER (ORDER BY nullif(n_regionkey, 2) DESC NULLS FIRST) AS r FROM nation"),
    ("rows_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM orders"),
    ("lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders"),
    ("agg_over_agg", "SELECT c_nationkey, round(sum(c_acctbal), 2) AS s, round(avg(sum(c_acctbal)) OVER (), 2) AS a FROM customer GROUP BY c_nationkey"),
    ("grouping_fn", "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) + grouping(o_orderpriority) AS g, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) + grouping(o_orderpriority) AS INT) AS g, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    ("rank_over_grouping", "SELECT l_returnflag, l_linestatus, rank() OVER (PARTITION BY grouping(l_returnflag) + grouping(l_linestatus) ORDER BY sum(l_quantity) DESC) AS r FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    ("filter_clause", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS n FROM orders GROUP BY o_orderstatus"),
    ("coalesce_round_abs", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS a, round(abs(c_acctbal), 1) AS b, substr(c_name, 1, 5) AS c, greatest(c_nationkey, 10) AS d FROM customer"),
]
NUMERIC = ["min", "max", "avg", "sum", "var_samp", "variance", "var_pop", "stddev", "stddev_samp", "stddev_pop"]
PAIRS = ["corr", "covar_pop", "covar_samp", "regr_sxx", "regr_sxy", "regr_syy", "regr_avgx", "regr_avgy", "regr_intercept", "regr_r2", "regr_slope"]
CONSTRUCTS += [
    ("agg_count_star", "SELECT o_orderstatus, count(*) AS v FROM orders GROUP BY o_orderstatus"),
    ("agg_count", "SELECT o_custkey, count(nullif(o_orderstatus, 'F')) AS v FROM orders GROUP BY o_custkey"),
    ("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS v, count(DISTINCT nullif(o_orderpriority, '2-HIGH')) AS w FROM orders GROUP BY o_orderstatus"),
    *((f"agg_{a}", f"SELECT l_returnflag, l_linestatus, round({a}(nullif(l_quantity, 7)), 6) + 0.0 AS v FROM lineitem GROUP BY l_returnflag, l_linestatus") for a in NUMERIC),
    *((f"agg_{a}_distinct", f"SELECT l_returnflag, round({a}(DISTINCT nullif(l_quantity, 7)), 6) AS v FROM lineitem GROUP BY l_returnflag") for a in ("sum", "avg", "min", "max", "var_samp", "stddev_pop")),
    *((f"agg_{a}", f"SELECT l_returnflag, l_linestatus, round({a}(l_quantity, nullif(l_discount, 0.05)), 5) + 0.0 AS v FROM lineitem GROUP BY l_returnflag, l_linestatus") for a in PAIRS),
    ("agg_regr_count", "SELECT l_returnflag, regr_count(l_quantity, nullif(l_discount, 0.05)) AS v FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(regr_count(l_quantity, nullif(l_discount, 0.05)) AS BIGINT) AS v FROM lineitem GROUP BY l_returnflag"),
    ("agg_string_agg", "SELECT n_regionkey, string_agg(n_name, ',') AS v FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS v FROM nation GROUP BY n_regionkey"),
    ("agg_string_agg_distinct", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '|') AS v FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS v FROM orders GROUP BY o_orderstatus"),
    ("agg_string_agg_order", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey DESC) AS v FROM nation GROUP BY n_regionkey"),
    ("agg_string_agg_delimiter", "SELECT n_regionkey, string_agg(n_name, '<' || n_name || '>') AS v FROM nation GROUP BY n_regionkey",
     "SELECT n_regionkey, string_agg(CASE WHEN rn = 1 THEN n_name ELSE '<' || n_name || '>' || n_name END, '' ORDER BY n_name) AS v FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rn FROM nation) GROUP BY n_regionkey"),
    ("agg_min_max_text", "SELECT p_type, min(p_name) AS a, max(p_brand) AS b FROM part GROUP BY p_type"),
    ("agg_min_max_date", "SELECT o_orderstatus, min(CAST(o_orderdate AS date)) AS a, max(o_orderdate) AS b FROM orders GROUP BY o_orderstatus"),
    ("agg_bool", "SELECT o_custkey, bool_and(o_totalprice > 20000) AS a, bool_or(o_totalprice > 300000) AS b, every(nullif(o_orderstatus, 'F') = 'O') AS c FROM orders GROUP BY o_custkey",
     "SELECT o_custkey, bool_and(o_totalprice > 20000) AS a, bool_or(o_totalprice > 300000) AS b, bool_and(nullif(o_orderstatus, 'F') = 'O') AS c FROM orders GROUP BY o_custkey"),
    ("agg_bit", "SELECT o_orderstatus, bit_and(o_custkey) AS a, bit_or(o_custkey) AS b, bit_xor(o_custkey) AS c FROM orders GROUP BY o_orderstatus"),
    ("agg_bit_int", "SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS b, bit_xor(n_nationkey) AS c, min(n_nationkey) AS d FROM nation GROUP BY n_regionkey"),
    ("agg_bit_xor_distinct", "SELECT o_orderstatus, bit_xor(DISTINCT o_custkey) AS c FROM orders GROUP BY o_orderstatus"),
    ("agg_empty", "SELECT count(*) AS a, sum(o_totalprice) AS b, max(o_orderkey) AS c, bool_and(o_orderkey > 0) AS d FROM orders WHERE o_orderkey < 0"),
    ("agg_sum_int", "SELECT n_regionkey, CAST(sum(n_nationkey) AS bigint) AS a, CAST(sum(DISTINCT n_regionkey) AS bigint) AS b FROM nation GROUP BY n_regionkey"),
]


def _register() -> None:
    for name, text, *oracle in CONSTRUCTS:
        query(name, oracle[0] if oracle else text)(lambda spark, sf_dir, text=text: run(spark, sf_dir, text))


_register()
