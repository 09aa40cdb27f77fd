"""The engine's registered queries: statements of the language over the driver's tables, each with equivalent SQL.

A query is one FETCH over registered Parquet, or a script that works on the engine's own tables in a fresh warehouse and
ends with a FETCH of their final state.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: name: (statement, SQL)
READS: dict[str, tuple[str, str]] = {
    "scan_star": ("FETCH * FROM customer", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "project_arith": ("FETCH l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 2) AS net FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS net FROM lineitem"),
    "filter_cmp": ("FETCH o_orderkey, o_totalprice FROM orders WHEN o_totalprice >= 150000", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 150000"),
    "filter_and_or_not": ("FETCH l_orderkey, l_linenumber FROM lineitem WHEN NOT (l_returnflag = 'R' OR l_linestatus = 'F') AND l_quantity < 10", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'R' OR l_linestatus = 'F') AND l_quantity < 10"),
    "filter_between": ("FETCH p_partkey, p_size FROM part WHEN p_size BETWEEN 10 AND 20", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size BETWEEN 10 AND 20"),
    "filter_not_between": ("FETCH p_partkey FROM part WHEN p_retailprice NOT BETWEEN 1000 AND 1500", "SELECT p_partkey FROM part WHERE p_retailprice NOT BETWEEN 1000 AND 1500"),
    "filter_in": ("FETCH c_custkey, c_mktsegment FROM customer WHEN c_nationkey IN (1, 3, 5, 7)", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey IN (1, 3, 5, 7)"),
    "filter_not_in": ("FETCH n_name FROM nation WHEN n_regionkey NOT IN (0, 2)", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (0, 2)"),
    "filter_like": ("FETCH p_partkey, p_type FROM part WHEN p_type LIKE '%A%' AND p_brand NOT LIKE '_rand#1%'", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_brand NOT LIKE '_rand#1%'"),
    "filter_is_null": ("FETCH c.c_custkey, o.o_orderkey FROM customer c LEFT LINK orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000 WHEN o.o_orderkey IS NULL", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000 WHERE o.o_orderkey IS NULL"),
    "filter_is_not_null": ("FETCH COUNT(*) AS n FROM customer c LEFT LINK orders o ON c.c_custkey = o.o_custkey WHEN o.o_orderkey IS NOT NULL", "SELECT count(*) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NOT NULL"),
    "filter_time_text": ("FETCH o_orderkey FROM orders WHEN o_orderdate > '1997-01-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01'"),
    "three_valued": ("FETCH c_custkey, ((NULLIF(c_nationkey, 3) = 5) OR c_nationkey > 20) AS a, ((NULLIF(c_nationkey, 3) = 5) AND c_nationkey > 20) AS b, (NOT (NULLIF(c_nationkey, 3) = 5)) AS c FROM customer", "SELECT c_custkey, (NULLIF(c_nationkey, 3) = 5) OR c_nationkey > 20 AS a, (NULLIF(c_nationkey, 3) = 5) AND c_nationkey > 20 AS b, NOT (NULLIF(c_nationkey, 3) = 5) AS c FROM customer"),
    "int_div_trunc": ("FETCH l_orderkey, l_linenumber, (0 - l_linenumber) / 2 AS h FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(trunc((0 - l_linenumber) / 2) AS BIGINT) AS h FROM lineitem"),
    "div_zero_null": ("FETCH p_partkey, p_size / (p_size - 10) AS q, p_retailprice / (p_size - 10) AS r FROM part WHEN p_size BETWEEN 9 AND 11", "SELECT p_partkey, CAST(trunc(p_size / nullif(p_size - 10, 0)) AS BIGINT) AS q, p_retailprice / nullif(p_size - 10, 0) AS r FROM part WHERE p_size BETWEEN 9 AND 11"),
    "mod_null": ("FETCH p_partkey, MOD(0 - p_size, 7) AS m, MOD(p_size, p_size - 10) AS z FROM part", "SELECT p_partkey, CAST((0 - p_size) % 7 AS BIGINT) AS m, CAST(p_size % nullif(p_size - 10, 0) AS BIGINT) AS z FROM part"),
    "unary_minus": ("FETCH s_suppkey, -s_acctbal AS neg, +s_acctbal AS pos FROM supplier", "SELECT s_suppkey, 0 - s_acctbal AS neg, s_acctbal AS pos FROM supplier"),
    "str_upper_lower": ("FETCH p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l FROM part", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l FROM part"),
    "str_length": ("FETCH c_custkey, LENGTH(c_name) AS n, LENGTH(c_custkey) AS d FROM customer", "SELECT c_custkey, CAST(strlen(c_name) AS BIGINT) AS n, CAST(strlen(CAST(c_custkey AS VARCHAR)) AS BIGINT) AS d FROM customer"),
    "str_substr": ("FETCH c_custkey, SUBSTR(c_name, 3, 4) AS a, SUBSTR(c_name, 5) AS b, SUBSTR(c_name, 0, 3) AS c, SUBSTR(c_name, 100, 2) AS d FROM customer", "SELECT c_custkey, substr(c_name, 3, 4) AS a, substr(c_name, 5) AS b, substr(c_name, 1, 3) AS c, '' AS d FROM customer"),
    "str_trim": ("FETCH n_name, TRIM('  x y  ') AS t FROM nation", "SELECT n_name, 'x y' AS t FROM nation"),
    "num_abs_round_ceil_floor": ("FETCH s_suppkey, ABS(s_acctbal) AS a, ROUND(s_acctbal) AS r, ROUND(s_acctbal, 1) AS r1, CEIL(s_acctbal) AS c, FLOOR(s_acctbal) AS f FROM supplier", "SELECT s_suppkey, abs(s_acctbal) AS a, sign(s_acctbal) * floor(abs(s_acctbal) + 0.5) AS r, sign(s_acctbal) * floor(abs(s_acctbal) * 10 + 0.5) / 10 AS r1, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f FROM supplier"),
    "round_large": ("FETCH p_partkey, ROUND(p_retailprice * 10000000000.0, 9) AS r, ROUND(0 - p_retailprice * 100000000000000000000.0) AS s FROM part", "SELECT p_partkey, p_retailprice * CAST(1e10 AS DOUBLE) AS r, 0 - p_retailprice * CAST(1e20 AS DOUBLE) AS s FROM part"),
    "int_overflow": ("FETCH n_nationkey, n_nationkey + 9223372036854775800 AS a, n_nationkey * 9223372036854775807 AS m, -9223372036854775807 - n_nationkey AS s FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, TRY_CAST(CAST(n_nationkey AS HUGEINT) + 9223372036854775800 AS BIGINT) AS a, TRY_CAST(CAST(n_nationkey AS HUGEINT) * 9223372036854775807 AS BIGINT) AS m, TRY_CAST(CAST(-9223372036854775807 AS HUGEINT) - n_nationkey AS BIGINT) AS s FROM nation"),
    "coalesce_nullif": ("FETCH c.c_custkey, COALESCE(o.o_orderkey, 0 - 1) AS k, NULLIF(c.c_mktsegment, 'BUILDING') AS s FROM customer c LEFT LINK orders o ON c.c_custkey = o.o_custkey", "SELECT c.c_custkey, coalesce(o.o_orderkey, -1) AS k, nullif(c.c_mktsegment, 'BUILDING') AS s FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey"),
    "cast_matrix": ("FETCH p_partkey, CAST(p_retailprice AS INT) AS i, CAST(p_size AS FLOAT) AS f, CAST((p_size > 25) AS INT) AS b, CAST((p_size > 25) AS TEXT) AS t, CAST(p_size AS TEXT) AS s, CAST('12abc' AS INT) AS p, CAST('x' AS INT) AS n, CAST('2.5e1z' AS FLOAT) AS e, CAST(p_size - 10 AS BOOL) AS z FROM part", "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS f, CAST(p_size > 25 AS BIGINT) AS b, upper(CAST(p_size > 25 AS VARCHAR)) AS t, CAST(p_size AS VARCHAR) AS s, CAST(12 AS BIGINT) AS p, CAST(NULL AS BIGINT) AS n, CAST(25 AS DOUBLE) AS e, p_size <> 10 AS z FROM part"),
    "case_when": ("FETCH o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS c, CASE WHEN o_orderstatus = 'F' THEN 1 END AS d FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS c, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 END AS BIGINT) AS d FROM orders"),
    "item_names": ("FETCH p_size + 1, p_partkey FROM part", 'SELECT CAST(p_size + 1 AS BIGINT) AS "(p_size + 1)", p_partkey FROM part'),
    "join_inner": ("FETCH o.o_orderkey, c.c_name FROM orders o LINK customer c ON o.o_custkey = c.c_custkey", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"),
    "join_left": ("FETCH c.c_custkey, o.o_orderkey FROM customer c LEFT LINK orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000"),
    "join_right": ("FETCH o.o_orderkey, c.c_custkey FROM orders o RIGHT LINK customer c ON o.o_custkey = c.c_custkey", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey"),
    "join_full": ("FETCH s.s_suppkey, c.c_custkey FROM supplier s FULL LINK customer c ON s.s_suppkey = c.c_custkey + 50", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey + 50"),
    "join_cross": ("FETCH r.r_name, n.n_name FROM region r CROSS LINK nation n", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n"),
    "join_theta": ("FETCH a.n_nationkey AS x, b.n_nationkey AS y FROM nation a LINK nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "SELECT CAST(a.n_nationkey AS BIGINT) AS x, CAST(b.n_nationkey AS BIGINT) AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_three_way": ("FETCH o.o_orderkey, n.n_name, r.r_name FROM orders o LINK customer c ON o.o_custkey = c.c_custkey LINK nation n ON c.c_nationkey = n.n_nationkey LINK region r ON n.n_regionkey = r.r_regionkey WHEN r.r_name = 'ASIA'", "SELECT o.o_orderkey, n.n_name, r.r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'"),
    "join_self_alias": ("FETCH a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a LINK supplier b ON a.s_nationkey = b.s_nationkey", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey"),
    "join_filter_after": ("FETCH c.c_custkey FROM customer c LEFT LINK orders o ON c.c_custkey = o.o_custkey WHEN o.o_totalprice > 200000", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 200000"),
    "agg_global": ("FETCH COUNT(*) AS n, SUM(l_quantity) AS q, MIN(l_quantity) AS lo, MAX(l_extendedprice) AS hi, COUNT(l_shipdate) AS d FROM lineitem", "SELECT count(*) AS n, sum(l_quantity) AS q, min(l_quantity) AS lo, max(l_extendedprice) AS hi, count(l_shipdate) AS d FROM lineitem"),
    "agg_group": ("FETCH l_returnflag, l_linestatus, SUM(l_quantity) AS q, COUNT(*) AS n, MIN(l_discount) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, count(*) AS n, min(l_discount) AS d FROM lineitem GROUP BY 1, 2"),
    "agg_avg": ("FETCH p_brand, AVG(p_size) AS a FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(p_size) AS DOUBLE) / count(p_size) AS a FROM part GROUP BY 1"),
    "agg_int_sum": ("FETCH SUM(p_size) AS s, MIN(p_name) AS lo, MAX(p_name) AS hi FROM part", "SELECT CAST(sum(p_size) AS BIGINT) AS s, min(p_name) AS lo, max(p_name) AS hi FROM part"),
    "agg_count_distinct": ("FETCH l_returnflag, COUNT(UNIQUEONLY l_suppkey) AS n, SUM(UNIQUEONLY l_linenumber) AS s, AVG(UNIQUEONLY l_linenumber) AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, CAST(sum(DISTINCT l_linenumber) AS DOUBLE) / count(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY 1"),
    "agg_having": ("FETCH o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 1000", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 1000"),
    "agg_empty_input": ("FETCH COUNT(*) AS n, SUM(l_quantity) AS q, AVG(l_tax) AS a FROM lineitem WHEN l_quantity < 0", "SELECT count(*) AS n, sum(l_quantity) AS q, avg(l_tax) AS a FROM lineitem WHERE l_quantity < 0"),
    "agg_skip_filter": ("FETCH COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHEN l_orderkey > 5000 AND l_quantity < 24", "SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_orderkey > 5000 AND l_quantity < 24"),
    "agg_over_join": ("FETCH n.n_name, COUNT(*) AS n FROM customer c LINK nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", "SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1"),
    "agg_expression": ("FETCH l_returnflag, SUM(l_quantity * 2) AS q FROM lineitem GROUP BY l_returnflag SORT BY l_returnflag", "SELECT l_returnflag, sum(l_quantity * 2) AS q FROM lineitem GROUP BY 1"),
    "agg_columns_first": ("FETCH COUNT(*), n_regionkey FROM nation GROUP BY n_regionkey", 'SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, count(*) AS "COUNT(*)" FROM nation GROUP BY n_regionkey'),
    "win_row_number": ("FETCH o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey SORT BY o_totalprice DESC, o_orderkey) AS rn FROM orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders"),
    "win_rank": ("FETCH p_partkey, RANK() OVER (PARTITION BY p_brand SORT BY p_size) AS r FROM part", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part"),
    "win_dense_rank": ("FETCH p_partkey, DENSE_RANK() OVER (PARTITION BY p_brand SORT BY p_size DESC) AS r FROM part", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part"),
    "win_rank_unsorted": ("FETCH s_suppkey, RANK() OVER (PARTITION BY s_nationkey) AS r FROM supplier", "SELECT s_suppkey, CAST(1 AS BIGINT) AS r FROM supplier"),
    "win_sum_partition": ("FETCH l_orderkey, l_linenumber, SUM(l_quantity) OVER (PARTITION BY l_orderkey) AS q, COUNT(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS q, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"),
    "win_agg_with_sort_is_total": ("FETCH p_partkey, SUM(p_size) OVER (PARTITION BY p_brand SORT BY p_partkey) AS s, MAX(p_size) OVER (PARTITION BY p_brand SORT BY p_partkey) AS m, MIN(p_size) OVER (PARTITION BY p_brand) AS l, COUNT(p_size) OVER (PARTITION BY p_brand) AS c FROM part", "SELECT p_partkey, CAST(sum(p_size) OVER w AS BIGINT) AS s, CAST(max(p_size) OVER w AS BIGINT) AS m, CAST(min(p_size) OVER w AS BIGINT) AS l, count(p_size) OVER w AS c FROM part WINDOW w AS (PARTITION BY p_brand)"),
    "win_avg": ("FETCH p_partkey, AVG(p_size) OVER (PARTITION BY p_brand) AS a FROM part", "SELECT p_partkey, CAST(sum(p_size) OVER w AS DOUBLE) / count(p_size) OVER w AS a FROM part WINDOW w AS (PARTITION BY p_brand)"),
    "win_whole": ("FETCH p_partkey, COUNT(*) OVER () AS n, SUM(p_size) OVER () AS s, MAX(p_retailprice) OVER () AS m, SUM(p_size) OVER (PARTITION BY p_brand) AS b FROM part WHEN p_size > 5", "SELECT p_partkey, count(*) OVER () AS n, CAST(sum(p_size) OVER () AS BIGINT) AS s, max(p_retailprice) OVER () AS m, CAST(sum(p_size) OVER (PARTITION BY p_brand) AS BIGINT) AS b FROM part WHERE p_size > 5"),
    "win_over_join": ("FETCH c.c_custkey, ROW_NUMBER() OVER (PARTITION BY n.n_name SORT BY c.c_acctbal DESC, c.c_custkey) AS rn FROM customer c LINK nation n ON c.c_nationkey = n.n_nationkey", "SELECT c.c_custkey, row_number() OVER (PARTITION BY n.n_name ORDER BY c.c_acctbal DESC, c.c_custkey) AS rn FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"),
    "sort_multi": ("FETCH c_mktsegment, c_custkey FROM customer SORT BY c_mktsegment DESC, c_custkey ASC", "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey"),
    "topk": ("FETCH o_orderkey, o_totalprice FROM orders SORT BY o_totalprice DESC, o_orderkey TAKE 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "take_skip": ("FETCH o_orderkey FROM orders SORT BY o_orderkey TAKE 10 SKIP 25", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25"),
    "skip_alone": ("FETCH n_nationkey FROM nation SORT BY n_nationkey SKIP 20", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20"),
    "sort_hidden_column": ("FETCH p_name FROM part SORT BY p_retailprice DESC, p_partkey", "SELECT p_name FROM part ORDER BY p_retailprice DESC, p_partkey"),
    "distinct": ("FETCH UNIQUEONLY l_returnflag, l_linestatus FROM lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "distinct_sort": ("FETCH UNIQUEONLY p_brand FROM part SORT BY p_brand", "SELECT DISTINCT p_brand FROM part ORDER BY p_brand"),
    "distinct_sort_hidden": ("FETCH UNIQUEONLY p_brand FROM part SORT BY p_partkey", "SELECT p_brand FROM part GROUP BY p_brand ORDER BY min(p_partkey)"),
    "union_all": ("FETCH s_nationkey FROM supplier UNION ALL FETCH c_nationkey FROM customer", "SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer"),
    "union": ("FETCH s_nationkey FROM supplier UNION FETCH c_nationkey FROM customer", "SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer"),
    "intersect": ("FETCH c_custkey FROM customer INTERSECT FETCH o_custkey FROM orders", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders"),
    "except": ("FETCH c_custkey FROM customer EXCEPT FETCH o_custkey FROM orders WHEN o_totalprice > 200000", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000"),
    "setop_left_assoc": ("FETCH n_nationkey FROM nation UNION FETCH s_suppkey FROM supplier INTERSECT FETCH r_regionkey FROM region", "(SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation UNION SELECT s_suppkey FROM supplier) INTERSECT SELECT r_regionkey FROM region"),
    "sub_scalar": ("FETCH o_orderkey FROM orders WHEN o_totalprice > (FETCH AVG(o_totalprice) FROM orders)", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)"),
    "sub_scalar_projection": ("FETCH r_name, (FETCH MAX(n_nationkey) FROM nation) AS m, 1 + (FETCH COUNT(*) FROM region) AS n FROM region", "SELECT r_name, CAST((SELECT max(n_nationkey) FROM nation) AS BIGINT) AS m, 1 + (SELECT count(*) FROM region) AS n FROM region"),
    "sub_in": ("FETCH c_custkey FROM customer WHEN c_custkey IN (FETCH o_custkey FROM orders WHEN o_totalprice > 200000)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"),
    "sub_not_in": ("FETCH c_custkey FROM customer WHEN c_custkey NOT IN (FETCH o_custkey FROM orders WHEN o_totalprice > 200000)", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"),
    "sub_not_in_null": ("FETCH n_name FROM nation WHEN n_regionkey NOT IN (FETCH NULLIF(r_regionkey, 1) FROM region WHEN r_regionkey < 3)", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (SELECT NULLIF(r_regionkey, 1) FROM region WHERE r_regionkey < 3)"),
    "sub_not_in_value": ("FETCH n_name, (n_regionkey NOT IN (FETCH NULLIF(r_regionkey, 1) FROM region WHEN r_regionkey < 3)) AS a, (NULLIF(n_regionkey, 4) NOT IN (FETCH r_regionkey FROM region WHEN r_regionkey < 2)) AS b FROM nation", "SELECT n_name, n_regionkey NOT IN (SELECT NULLIF(r_regionkey, 1) FROM region WHERE r_regionkey < 3) AS a, NULLIF(n_regionkey, 4) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2) AS b FROM nation"),
    "sub_not_in_and": ("FETCH s_suppkey FROM supplier WHEN s_acctbal > 0 AND NULLIF(s_nationkey, 3) NOT IN (FETCH n_nationkey FROM nation WHEN n_regionkey = 1) AND s_suppkey > 2", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND NULLIF(s_nationkey, 3) NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND s_suppkey > 2"),
    "sub_not_in_empty": ("FETCH n_name FROM nation WHEN NULLIF(n_regionkey, 2) NOT IN (FETCH r_regionkey FROM region WHEN r_regionkey > 90)", "SELECT n_name FROM nation WHERE NULLIF(n_regionkey, 2) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 90)"),
    "sub_exists": ("FETCH c_custkey FROM customer c WHEN EXISTS (FETCH o_orderkey FROM orders o WHEN o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)"),
    "sub_not_exists": ("FETCH c_custkey FROM customer c WHEN NOT EXISTS (FETCH o_orderkey FROM orders o WHEN o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)"),
    "sub_corr_scalar": ("FETCH o_orderkey FROM orders o WHEN o_totalprice > (FETCH AVG(o_totalprice) FROM orders i WHEN i.o_custkey = o.o_custkey)", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)"),
    "sub_corr_projection_count": ("FETCH n_name, (FETCH COUNT(*) FROM customer c WHEN c.c_nationkey = n.n_nationkey) AS k FROM nation n", "SELECT n_name, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS k FROM nation n"),
    "sub_corr_unequal": ("FETCH r_name, (FETCH MIN(n_nationkey) FROM nation n WHEN n.n_regionkey > r.r_regionkey) AS m FROM region r", "SELECT r_name, CAST((SELECT min(n_nationkey) FROM nation n WHERE n.n_regionkey > r.r_regionkey) AS BIGINT) AS m FROM region r"),
    "revenue_by_nation": ("FETCH n.n_name, COUNT(*) AS n, SUM(l.l_quantity) AS q FROM lineitem l LINK orders o ON l.l_orderkey = o.o_orderkey LINK customer c ON o.o_custkey = c.c_custkey LINK nation n ON c.c_nationkey = n.n_nationkey WHEN l.l_discount < 0.05 GROUP BY n.n_name SORT BY n.n_name", "SELECT n.n_name, count(*) AS n, sum(l.l_quantity) AS q FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE l.l_discount < 0.05 GROUP BY 1"),
    "events_by_type": ("FETCH event_type, COUNT(*) AS n, COUNT(UNIQUEONLY user_id) AS u, MIN(ts) AS first_ts FROM events GROUP BY event_type", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS u, min(ts) AS first_ts FROM events GROUP BY 1"),
}

_NATION = "BUILD RELATION t AS FETCH n_nationkey AS id, n_name AS name, n_regionkey AS reg FROM nation"
_OWN = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS reg FROM nation"
_UNIQUE = "BUILD RELATION t (id INT PRIMARY KEY, name TEXT, hits INT DEFAULT 0)"

#: name: (script whose last statement is the query, SQL)
WRITES: dict[str, tuple[str, str]] = {
    "ctas_filter": ("BUILD RELATION t AS FETCH c_custkey, c_name FROM customer WHEN c_acctbal > 5000; FETCH * FROM t", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000"),
    "view_over_join_agg": ("BUILD VIEW v AS FETCH c.c_nationkey AS k, o.o_totalprice AS p FROM customer c LINK orders o ON c.c_custkey = o.o_custkey; FETCH k, COUNT(*) AS n, MAX(p) AS m FROM v WHEN p > 1000 GROUP BY k", "SELECT CAST(c.c_nationkey AS BIGINT) AS k, count(*) AS n, max(o.o_totalprice) AS m FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 1000 GROUP BY 1"),
    "put_values": ("BUILD RELATION t (id INT, name VARCHAR(8) NOT NULL, price FLOAT, ok BOOL, d DATE); PUT INTO t VALUES (1, 'a''b', 2, TRUE, '2024-01-01'), (2, 'c', NULL, FALSE, NULL); PUT INTO t (name, id) VALUES ('d', -3); FETCH * FROM t", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a''b', CAST(2 AS DOUBLE), TRUE, '2024-01-01'), (2, 'c', NULL, FALSE, NULL), (-3, 'd', NULL, NULL, NULL)) AS x(id, name, price, ok, d)"),
    "put_default_auto": ("BUILD RELATION t (id INT AUTO_INCREMENT, n INT DEFAULT 7, s TEXT DEFAULT 'x'); PUT INTO t DEFAULT VALUES; PUT INTO t (n) VALUES (8), (9); FETCH * FROM t", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(7 AS BIGINT), 'x'), (2, 8, 'x'), (3, 9, 'x')) AS x(id, n, s)"),
    "insert_select": (f"{_NATION}; PUT INTO t FETCH n_nationkey + 100, n_name, n_regionkey FROM nation WHEN n_regionkey = 1; FETCH * FROM t", f"{_OWN} UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1"),
    "update_case": (f"{_NATION}; MODIFY t SET reg = CASE WHEN reg = 1 THEN 10 ELSE reg + 1 END, name = LOWER(name) WHEN id < 20; FETCH * FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey < 20 THEN lower(n_name) ELSE n_name END AS name, CAST(CASE WHEN n_nationkey >= 20 THEN n_regionkey WHEN n_regionkey = 1 THEN 10 ELSE n_regionkey + 1 END AS BIGINT) AS reg FROM nation"),
    "update_from": (f"{_NATION}; MODIFY t SET name = r.r_name FROM region r WHEN t.reg = r.r_regionkey AND r.r_regionkey > 1; FETCH * FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_regionkey > 1 THEN r_name ELSE n_name END AS name, CAST(n_regionkey AS BIGINT) AS reg FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "update_subquery": (f"{_NATION}; MODIFY t SET reg = (FETCH MAX(r_regionkey) FROM region) WHEN id IN (FETCH c_nationkey FROM customer WHEN c_acctbal > 9900); FETCH * FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) THEN (SELECT max(r_regionkey) FROM region) ELSE n_regionkey END AS BIGINT) AS reg FROM nation"),
    "delete_when": (f"{_NATION}; REMOVE FROM t WHEN reg = 2 OR name LIKE 'A%'; FETCH * FROM t", f"{_OWN} WHERE NOT (n_regionkey = 2 OR n_name LIKE 'A%')"),
    "delete_correlated": (f"{_NATION}; REMOVE FROM t WHEN EXISTS (FETCH s_suppkey FROM supplier s WHEN s.s_nationkey = t.id AND s.s_acctbal > 9000); FETCH * FROM t", f"{_OWN} WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)"),
    "truncate": (f"{_NATION}; TRUNCATE RELATION t; FETCH COUNT(*) AS n FROM t", "SELECT CAST(0 AS BIGINT) AS n"),
    "upsert": (f"{_UNIQUE}; PUT INTO t (id, name) VALUES (1, 'a'), (2, 'b'); PUT INTO t (id, name) VALUES (2, 'x'), (3, 'c'), (2, 'y'), (3, 'z') ON CONFLICT (id) DO MODIFY SET hits = hits + 1; FETCH * FROM t", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST(0 AS BIGINT)), (2, 'b', 2), (3, 'c', 1)) AS x(id, name, hits)"),
    "upsert_nothing": (f"{_UNIQUE}; PUT INTO t (id, name) VALUES (1, 'a'); PUT INTO t (id, name) VALUES (1, 'x'), (4, 'd') ON CONFLICT (id) DO NOTHING; FETCH id, name FROM t", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (4, 'd')) AS x(id, name)"),
    "returning": (f"{_NATION}; MODIFY t SET reg = reg * 10 WHEN id < 5 RETURNING id, reg", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey * 10 AS BIGINT) AS reg FROM nation WHERE n_nationkey < 5"),
    "returning_remove": (f"{_NATION}; REMOVE FROM t WHEN reg = 3 RETURNING *", f"{_OWN} WHERE n_regionkey = 3"),
    "time_travel": (f"{_NATION}; MODIFY t SET name = 'x' WHEN reg = 1; REMOVE FROM t WHEN reg = 2; FETCH * FROM t AS OF 2", "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_regionkey = 1 THEN 'x' ELSE n_name END AS name, CAST(n_regionkey AS BIGINT) AS reg FROM nation"),
    "txn_undo": (f"{_NATION}; START; REMOVE FROM t; PUT INTO t VALUES (1, 'x', 2); UNDO; FETCH * FROM t", _OWN),
    "txn_save": (f"{_NATION}; START; REMOVE FROM t WHEN id > 2; MODIFY t SET reg = 9; SAVE; FETCH * FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(9 AS BIGINT) AS reg FROM nation WHERE n_nationkey <= 2"),
    "fk_cascade": ("BUILD RELATION p (id INT PRIMARY KEY); BUILD RELATION c (id INT PRIMARY KEY, p INT REFERENCES p(id) ON REMOVE CASCADE); BUILD RELATION g (id INT, c INT REFERENCES c(id) ON REMOVE SET NULL); PUT INTO p VALUES (1), (2); PUT INTO c VALUES (10, 1), (11, 2); PUT INTO g VALUES (20, 10), (21, 11); REMOVE FROM p WHEN id = 1; FETCH * FROM g", "SELECT * FROM (VALUES (CAST(20 AS BIGINT), CAST(NULL AS BIGINT)), (21, 11)) AS x(id, c)"),
    "fk_modify_cascade": ("BUILD RELATION p (id INT PRIMARY KEY); BUILD RELATION c (id INT, p INT REFERENCES p(id) ON MODIFY CASCADE); PUT INTO p VALUES (1), (2); PUT INTO c VALUES (10, 1), (11, 2), (12, 1); MODIFY p SET id = 99 WHEN id = 1; FETCH * FROM c", "SELECT * FROM (VALUES (CAST(10 AS BIGINT), CAST(99 AS BIGINT)), (11, 2), (12, 99)) AS x(id, p)"),
    "reshape_add": (f"{_NATION}; RESHAPE RELATION t ADD COLUMN note TEXT; PUT INTO t VALUES (100, 'new', 1, 'n'); FETCH id, note FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS note FROM nation UNION ALL SELECT 100, 'n'"),
    "reshape_discard": (f"{_NATION}; RESHAPE RELATION t DISCARD COLUMN name; FETCH * FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS reg FROM nation"),
    "index_lookup": (f"{_NATION}; BUILD INDEX i ON t (id, reg); FETCH name FROM t WHEN id = 3 AND reg = 3", "SELECT n_name AS name FROM nation WHERE n_nationkey = 3 AND n_regionkey = 3"),
    "index_range": (f"{_NATION}; BUILD INDEX i ON t (id); FETCH name FROM t WHEN id BETWEEN 5 AND 9", "SELECT n_name AS name FROM nation WHERE n_nationkey BETWEEN 5 AND 9"),
    "put_returning": ("BUILD RELATION t (id INT AUTO_INCREMENT, s TEXT DEFAULT 'none'); PUT INTO t (s) VALUES ('p'), ('q') RETURNING id, s", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'p'), (2, 'q')) AS x(id, s)"),
    "upsert_returning": (f"{_UNIQUE}; PUT INTO t (id, name) VALUES (7, 'g'); PUT INTO t (id, name) VALUES (7, 'h'), (8, 'i') ON CONFLICT (id) DO MODIFY SET hits = hits + 5 RETURNING *", "SELECT * FROM (VALUES (CAST(7 AS BIGINT), 'g', CAST(5 AS BIGINT)), (8, 'i', 0)) AS x(id, name, hits)"),
    "modify_from_returning": (f"{_NATION}; MODIFY t SET name = r.r_name FROM region r WHEN t.reg = r.r_regionkey AND t.id < 6 RETURNING id, name", "SELECT CAST(n_nationkey AS BIGINT) AS id, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 6"),
    "fk_modify_set_null": ("BUILD RELATION p (id INT PRIMARY KEY); BUILD RELATION c (id INT, p INT REFERENCES p(id) ON MODIFY SET NULL); PUT INTO p VALUES (5), (6); PUT INTO c VALUES (50, 5), (60, 6); MODIFY p SET id = 55 WHEN id = 5; FETCH * FROM c", "SELECT * FROM (VALUES (CAST(50 AS BIGINT), CAST(NULL AS BIGINT)), (60, 6)) AS x(id, p)"),
    "as_of_join": (f"{_NATION}; BUILD RELATION u AS FETCH r_regionkey AS rid, r_name AS rname FROM region; MODIFY t SET name = 'gone'; REMOVE FROM u WHEN rid > 1; FETCH t.name, u.rname FROM t AS OF 2 LINK u ON t.reg = u.rid", "SELECT n_name AS name, r_name AS rname FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "txn_reads_own_writes": (f"{_NATION}; START; REMOVE FROM t WHEN id > 9; MODIFY t SET reg = 0 - reg; FETCH id, reg FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(0 - n_regionkey AS BIGINT) AS reg FROM nation WHERE n_nationkey <= 9"),
    "first_row_of_group": (f"{_NATION}; FETCH reg, id, COUNT(*) AS n FROM t GROUP BY reg", "SELECT CAST(n_regionkey AS BIGINT) AS reg, CAST(min(n_nationkey) AS BIGINT) AS id, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "discard_and_build_again": (f"{_NATION}; BUILD VIEW v AS FETCH id FROM t; DISCARD VIEW v; DISCARD RELATION t; BUILD RELATION t (k INT); PUT INTO t VALUES (4); BUILD VIEW v AS FETCH k + 1 AS j FROM t; FETCH * FROM v", "SELECT CAST(5 AS BIGINT) AS j"),
    "explain": (f"{_NATION}; EXPLAIN FETCH UNIQUEONLY name FROM t WHEN id = 3 SORT BY name TAKE 5 SKIP 1", "SELECT * FROM (VALUES ('Limit 5 offset 1'), ('  Unique'), ('    Sort'), ('      Filter'), ('        Seq Scan on t')) AS x(plan)"),
}

#: name: (script, the message or the error of each of its statements in order)
SAID: dict[str, tuple[str, list[str]]] = {
    "messages": (
        "BUILD RELATION t (id INT PRIMARY KEY, v INT); PUT INTO t VALUES (1, 1), (2, 2); MODIFY t SET v = 3 WHEN id = 1; REMOVE FROM t WHEN id = 2; BUILD INDEX i ON t (v); BUILD VIEW w AS FETCH id FROM t; START; UNDO; SAVE; RESHAPE RELATION t ADD COLUMN z TEXT; TRUNCATE RELATION t; DISCARD INDEX i; DISCARD VIEW w; DISCARD RELATION t",
        ["BUILD RELATION", "PUT 0 2", "MODIFY 1", "REMOVE 1", "BUILD INDEX", "BUILD VIEW", "START", "UNDO", "WARNING: no transaction in progress", "RESHAPE RELATION", "TRUNCATE RELATION", "DISCARD INDEX", "DISCARD VIEW", "DISCARD RELATION"],
    ),
    "constraint_errors": (
        "BUILD RELATION t (id INT PRIMARY KEY, s VARCHAR(4) NOT NULL, n INT CHECK (n > 5), u INT UNIQUE); PUT INTO t VALUES (1, 'abcd', 6, 1); PUT INTO t VALUES (1, 'a', 7, 2); PUT INTO t VALUES (2, NULL, 7, 2); PUT INTO t VALUES (2, 'abcde', 7, 2); PUT INTO t VALUES (2, 'a', 5, 2); PUT INTO t VALUES (2, 'a', 7, 1)",
        ["BUILD RELATION", "PUT 0 1", "ERROR  runtime error: UNIQUE constraint failed: t.id", "ERROR  runtime error: NOT NULL constraint failed: t.s", "ERROR  runtime error: value too long for column 's' (max 4)", "ERROR  runtime error: CHECK constraint failed: t.n", "ERROR  runtime error: UNIQUE constraint failed: t.u"],
    ),
    "composite_key_error": (
        "BUILD RELATION t (a INT, b INT, PRIMARY KEY (a, b)); PUT INTO t VALUES (1, 1), (1, 2); PUT INTO t VALUES (1, 2)",
        ["BUILD RELATION", "PUT 0 2", "ERROR  runtime error: PRIMARY KEY constraint failed: t"],
    ),
    "reference_errors": (
        "BUILD RELATION p (id INT PRIMARY KEY); BUILD RELATION c (id INT, p INT REFERENCES p(id)); PUT INTO p VALUES (1), (2); PUT INTO c VALUES (10, 1); PUT INTO c VALUES (11, 3); REMOVE FROM p WHEN id = 1; MODIFY p SET id = 4 WHEN id = 1; REMOVE FROM p WHEN id = 2",
        ["BUILD RELATION", "BUILD RELATION", "PUT 0 2", "PUT 0 1", "ERROR  runtime error: foreign key violation: value not present in p(id)", "ERROR  runtime error: foreign key violation: row is referenced by table 'c'", "ERROR  runtime error: foreign key violation: row is referenced by table 'c'", "REMOVE 1"],
    ),
}


def _folder(spark: SparkSession) -> str:
    """A fresh warehouse in the folder that all executors share; a temporary one where all tasks are in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="warehouse-")
    return f"{base.rstrip('/')}/warehouse-{uuid.uuid4().hex}"


def _engine(spark: SparkSession, sf_dir: str, warehouse: str | None, text: str) -> Engine:
    engine = Engine(spark, warehouse)
    for name in TABLES:
        if name in text:
            engine.register_parquet(name, f"{sf_dir}/{name}.parquet")
    return engine


def _read(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _engine(spark, sf_dir, None, text).frame(text)


def _written(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _engine(spark, sf_dir, _folder(spark), text)
        for found in (results := engine.run_script(text)):
            if isinstance(found, Exception):
                raise found
        return results[-1].frame

    return run


def _persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another session over the same warehouse sees: tables, views, and the version before the last."""
    folder = _folder(spark)
    text = f"{_NATION}; BUILD VIEW v AS FETCH id, name FROM t WHEN reg = 2; REMOVE FROM t WHEN id > 20"
    for found in _engine(spark, sf_dir, folder, text).run_script(text):
        if isinstance(found, Exception):
            raise found
    return Engine(spark, folder).frame("FETCH id, name FROM v AS OF 1")


def _said(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _engine(spark, sf_dir, _folder(spark), text).run_script(text)
        return spark.createDataFrame([(i, str(x) if isinstance(x, Exception) else x.message) for i, x in enumerate(found)], "step bigint, said string")

    return run


def _said_sql(lines: list[str]) -> str:
    rows = ", ".join(f"(CAST({i} AS BIGINT), '{x.replace(chr(39), 2 * chr(39))}')" for i, x in enumerate(lines))
    return f"SELECT * FROM (VALUES {rows}) AS x(step, said)"


QUERIES = {name: _read(text) for name, (text, _) in READS.items()} | {name: _written(text) for name, (text, _) in WRITES.items()}
QUERIES |= {name: _said(text) for name, (text, _) in SAID.items()} | {"persistence": _persisted}
SQL = {name: sql for name, (_, sql) in (READS | WRITES).items()} | {name: _said_sql(lines) for name, (_, lines) in SAID.items()}
SQL["persistence"] = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_regionkey = 2"
