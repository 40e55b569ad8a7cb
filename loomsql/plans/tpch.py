"""Analytical queries over the star schema, in the dialect. Columns the tables lack are left out or replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialect.engine import run
from ..session import table
from .registry import query


@query(
    "tpch_q1",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
           round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc,
           count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus
    """,
)
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '2001-09-02 00:00:00'")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(disc), 2).alias("sum_disc_price"),
        F.round(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.round(F.avg("l_extendedprice"), 6).alias("avg_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


REVENUE = "round(sum(l_extendedprice * (1 - l_discount)), 2)"
#: What parts cost at their suppliers and how many were sold, in place of the table of part suppliers.
PARTSUPP = """WITH partsupp AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_supplycost, sum(l_quantity) AS ps_availqty
          FROM lineitem GROUP BY l_partkey, l_suppkey)"""
TEXTS = {
    "tpch_q2": f"""
        {PARTSUPP}
        SELECT s_acctbal, s_name, n_name, p_partkey FROM part, supplier, partsupp, nation, region
        WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size < 30 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
          AND ps_supplycost = (
            SELECT min(x.ps_supplycost) FROM partsupp AS x, supplier AS t, nation AS m, region AS q
            WHERE p_partkey = x.ps_partkey AND t.s_suppkey = x.ps_suppkey AND t.s_nationkey = m.n_nationkey AND m.n_regionkey = q.r_regionkey AND q.r_name = 'ASIA')
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q9": f"""
        {PARTSUPP}
        SELECT n_name AS nation, CAST(EXTRACT(year FROM o_orderdate) AS int) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 2) AS sum_profit
        FROM part, supplier, lineitem, partsupp, orders, nation
        WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_type LIKE 'PROMO%'
        GROUP BY n_name, CAST(EXTRACT(year FROM o_orderdate) AS int)""",
    "tpch_q11": f"""
        {PARTSUPP}
        SELECT ps_partkey, round(sum(ps_supplycost * ps_availqty), 2) AS worth FROM partsupp, supplier, nation
        WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 2 GROUP BY ps_partkey
        HAVING sum(ps_supplycost * ps_availqty) > (
          SELECT sum(ps_supplycost * ps_availqty) * 0.001 FROM partsupp, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 2)""",
    "tpch_q12": """
        SELECT l_returnflag, count(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 END) AS high_line_count,
               count(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 END) AS low_line_count
        FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('R', 'A') AND o_orderdate < l_shipdate AND l_shipdate >= '1997-01-01' AND l_shipdate < '1998-01-01'
        GROUP BY l_returnflag""",
    "tpch_q16": f"""
        {PARTSUPP}
        SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp, part
        WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
          AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000)
        GROUP BY p_brand, p_type, p_size""",
    "tpch_q20": f"""
        {PARTSUPP}
        SELECT s_name FROM supplier, nation
        WHERE s_suppkey IN (
          SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_type LIKE 'LARGE%')
            AND ps_availqty > (SELECT 1.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= '1996-01-01' AND l_shipdate < '1999-01-01'))
          AND s_nationkey = n_nationkey AND n_regionkey = 1""",
    "tpch_q3": f"""
        SELECT l_orderkey, {REVENUE} AS revenue, o_orderdate FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
          AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q4": """
        SELECT o_orderpriority, count(*) AS order_count FROM orders
        WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00'
          AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
        GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tpch_q5": f"""
        SELECT n_name, {REVENUE} AS revenue FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
          AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
          AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00'
        GROUP BY n_name""",
    "tpch_q6": """
        SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'
          AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""",
    "tpch_q7": f"""
        SELECT supp_nation, cust_nation, l_year, {REVENUE} AS revenue FROM (
          SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS bigint) AS l_year, l_extendedprice, l_discount
          FROM supplier, lineitem, orders, customer, nation AS n1, nation AS n2
          WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
            AND (n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2' OR n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) AS shipping
        GROUP BY supp_nation, cust_nation, l_year""",
    "tpch_q8": """
        SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
          SELECT CAST(extract(year FROM o_orderdate) AS bigint) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
          FROM part, supplier, lineitem, orders, customer, nation AS n1, nation AS n2, region
          WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
            AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY') AS all_nations
        GROUP BY o_year""",
    "tpch_q10": f"""
        SELECT c_custkey, c_name, {REVENUE} AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1997-10-01 00:00:00'
          AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q13": """
        SELECT c_count, count(*) AS custdist FROM (
          SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%'
          GROUP BY c_custkey) AS c_orders
        GROUP BY c_count""",
    "tpch_q14": """
        SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
        FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-10-01 00:00:00'""",
    "tpch_q15": f"""
        WITH revenue (supplier_no, total_revenue) AS (
          SELECT l_suppkey, {REVENUE} FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-04-01 00:00:00' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)""",
    "tpch_q17": """
        SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part
        WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM lineitem AS i WHERE i.l_partkey = p_partkey)""",
    "tpch_q18": """
        SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS q FROM customer, orders, lineitem
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    "tpch_q19": f"""
        SELECT {REVENUE} AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND (
          p_type = 'PROMO' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15 OR
          p_type = 'SMALL' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30 OR
          p_type = 'LARGE' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)""",
    "tpch_q21": """
        SELECT s_name, count(*) AS numwait FROM supplier, lineitem AS l1, orders, nation
        WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND s_nationkey = n_nationkey
          AND EXISTS (SELECT 1 FROM lineitem AS l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM lineitem AS l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > l1.l_shipdate)
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": """
        SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
        WHERE c_nationkey IN (1, 3, 5, 7, 9, 11, 13) AND c_acctbal > (SELECT avg(d.c_acctbal) FROM customer AS d WHERE d.c_acctbal > 0.00)
          AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
        GROUP BY c_nationkey""",
    # The shape of report queries: channels united, rolled up, ranked within their parent.
    "report_rollup_rank": """
        SELECT r_name, n_name, round(sum(o_totalprice), 2) AS total, grouping(r_name) + grouping(n_name) AS lochierarchy,
               rank() OVER (PARTITION BY grouping(r_name) + grouping(n_name), CASE WHEN grouping(n_name) = 0 THEN r_name END ORDER BY sum(o_totalprice) DESC) AS rank_within_parent
        FROM orders, customer, nation, region WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey
        GROUP BY ROLLUP (r_name, n_name)""",
    "report_channels": """
        WITH channels AS (
          SELECT 'customer' AS channel, c_nationkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier)
        SELECT channel, k, round(sum(v), 2) AS s, count(*) AS n FROM channels GROUP BY ROLLUP (channel, k)""",
    "report_cumulative": """
        SELECT k, d, round(sum(s) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS cume FROM (
          SELECT c_nationkey AS k, o_orderdate AS d, sum(o_totalprice) AS s FROM orders, customer WHERE o_custkey = c_custkey GROUP BY c_nationkey, o_orderdate) AS daily""",
    "report_full_join": """
        SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM
          (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) AS a
          FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 3000 GROUP BY s_nationkey) AS b ON a.k = b.k""",
    "report_set_ops": """
        SELECT count(*) AS n FROM (
          SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
          EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS both_kinds""",
    "report_ratio_to_class": """
        SELECT p_type, p_brand, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice) * 100 / sum(sum(l_extendedprice)) OVER (PARTITION BY p_type), 6) AS ratio
        FROM lineitem, part WHERE l_partkey = p_partkey GROUP BY p_type, p_brand""",
}
for _name, _text in TEXTS.items():
    query(_name, _text.replace("grouping(r_name) + grouping(n_name) AS", "CAST(grouping(r_name) + grouping(n_name) AS INT) AS"))(lambda spark, sf_dir, text=_text: run(spark, sf_dir, text))
