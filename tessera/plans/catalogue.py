"""Registered queries of the relational engine, each with its oracle SQL.

A query is (tables, Spark SQL, DuckDB SQL or None when one text serves both). Texts in the engine's own dialect (QUALIFY,
regexp_replace of the first match, strftime and so on) go through tessera.plans.dialect and carry the DuckDB text they stand for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import dialect, questions, write_queries
from tessera.session import register

Query = Callable[[SparkSession, str], DataFrame]

# Tables that questions are asked about.
_ASKED = {"orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"], "events": ["event_id", "ts", "event_type"]}

# Inline rows shared by queries about NULLs, which no generated table has.
_A = "(VALUES (1,10),(2,20),(3,30),(4,40),(CAST(NULL AS INT),50)) AS a(k, w)"
_B = "(VALUES (2,200),(3,300),(5,500),(CAST(NULL AS INT),600)) AS b(k, v)"
_G = "(VALUES (1,10,1.0),(1,11,2.0),(1,11,3.0),(2,10,4.0),(CAST(NULL AS INT),10,5.0),(2,CAST(NULL AS INT),6.0)) AS g(a, b, x)"
_S = "(VALUES (1,'abc',2.5),(2,'AbCd',0.125),(3,'  x  ',3.5),(4,'xax',-2.5),(5,CAST(NULL AS VARCHAR(9)),CAST(NULL AS DOUBLE)),(6,'fg,hij',1.0)) AS s(k, s, v)"
_D = (
    "(VALUES (TIMESTAMP '2023-01-15 12:30:45', DATE '2023-01-20'),(TIMESTAMP '2023-02-20 03:04:05', DATE '2023-03-25'),"
    "(TIMESTAMP '2023-12-31 23:59:59', DATE '2024-01-02'),(TIMESTAMP '2024-02-29 00:00:00', DATE '2024-03-05'),(CAST(NULL AS TIMESTAMP), CAST(NULL AS DATE))) AS d(ts, d2)"
)

SQL: dict[str, tuple[str, str, str | None]] = {
    # Headline queries.
    "q1": (
        "lineitem",
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
                  round(sum(l_extendedprice), 2) AS sum_base_price,
                  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
                  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
                  round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price,
                  round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
           FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
           GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
        None,
    ),
    "q3": (
        "customer orders lineitem",
        """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
           FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
           WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
           GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
        None,
    ),
    "q6": (
        "lineitem",
        """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem
           WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00'
             AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
        None,
    ),
    "scan_agg_full": (
        "lineitem",
        """SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s, round(avg(l_quantity), 4) AS q,
                  round(min(l_discount), 4) AS md, round(max(l_tax), 4) AS mt FROM lineitem WHERE l_quantity > 25""",
        None,
    ),
    "four_table_join": (
        "lineitem orders customer nation",
        """SELECT n_name, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""",
        None,
    ),
    "high_card_group": (
        "lineitem",
        """SELECT l_orderkey, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, count(*) AS count_order
           FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_orderkey ORDER BY l_orderkey""",
        None,
    ),
    "high_card_minmax": (
        "lineitem",
        """SELECT l_orderkey, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, round(avg(l_quantity), 6) AS avg_qty
           FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_orderkey ORDER BY l_orderkey""",
        None,
    ),
    "join_high_card": (
        "orders lineitem",
        """SELECT o_orderkey, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, count(*) AS count_order
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey ORDER BY o_orderkey""",
        None,
    ),
    "join_where_filter": (
        "lineitem orders customer nation",
        """SELECT n_name, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_quantity < 24
           GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""",
        None,
    ),
    "join_fact_key": (
        "orders lineitem",
        """SELECT l_orderkey, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           WHERE o_orderdate < TIMESTAMP '1998-03-15 00:00:00' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10""",
        None,
    ),
    "join_multi_key_dim": (
        "orders lineitem",
        """SELECT o_orderdate, o_orderstatus, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           WHERE o_orderdate < TIMESTAMP '1998-03-15 00:00:00' GROUP BY o_orderdate, o_orderstatus ORDER BY revenue DESC, o_orderdate LIMIT 10""",
        None,
    ),
    # Scans, projections, predicates.
    "scan_project": ("part", "SELECT p_partkey, p_retailprice * 2 AS twice, -p_size AS neg, p_size % 7 AS m, p_size / 4 AS q FROM part", None),
    "scan_sample": ("region", "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 3", None),
    "filter_predicates": (
        "part",
        """SELECT p_partkey FROM part WHERE (p_size BETWEEN 5 AND 20 OR p_size IN (30, 40)) AND NOT p_brand = 'Brand#11' AND p_name LIKE '%a%' AND p_type IS NOT NULL AND p_size <> 7""",
        None,
    ),
    "like_ilike": ("", f"SELECT k, s LIKE 'a%' AS l1, s ILIKE 'AB_%' AS l2, s NOT LIKE '%x%' AS l3 FROM {_S}", None),
    "case_coalesce_nullif": (
        "",
        f"""SELECT k, CASE WHEN v > 1 THEN 'big' WHEN v < 0 THEN 'neg' ELSE 'small' END AS c1, CASE k WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS c2,
                   coalesce(v, -1.0) AS c3, nullif(k, 3) AS c4, greatest(v, 1.0) AS c5, least(v, k) AS c6 FROM {_S}""",
        f"""SELECT k, CASE WHEN v > 1 THEN 'big' WHEN v < 0 THEN 'neg' ELSE 'small' END AS c1, CASE k WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS c2,
                   coalesce(v, -1.0) AS c3, nullif(k, 3) AS c4, greatest(v, 1.0) AS c5, least(v, k) AS c6 FROM {_S}""",
    ),
    "cast_rounding": (
        "lineitem",
        "SELECT round_int(l_extendedprice) AS r, count(*) AS n, CAST(l_linenumber AS VARCHAR(5)) AS s, CAST(l_quantity > 25 AS BOOLEAN) AS b FROM lineitem GROUP BY 1, 3, 4",
        "SELECT CAST(l_extendedprice AS BIGINT) AS r, count(*) AS n, CAST(l_linenumber AS VARCHAR) AS s, l_quantity > 25 AS b FROM lineitem GROUP BY 1, 3, 4",
    ),
    "null_logic": (
        "",
        f"SELECT k, w, k IS NULL AS n1, k IS NOT NULL AS n2, (k = 1 OR NULL) AS n3, (k = 1 AND NULL) AS n4, k IN (1, NULL) AS n5, k NOT IN (2, 3) AS n6 FROM {_A}",
        None,
    ),
    "cast_types": (
        "part",
        "SELECT p_partkey, CAST(p_retailprice AS INT) AS i, CAST(2.5 AS BIGINT) AS d, CAST(p_size AS VARCHAR) AS s, CAST(p_size AS REAL) AS r, CAST(p_size AS BIGINT) AS b, CAST('1995-03-04' AS DATE) AS dt FROM part",
        None,
    ),
    # Joins.
    "join_inner": ("", f"SELECT a.k, w, v FROM {_A} JOIN {_B} ON a.k = b.k", None),
    "join_left": ("customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY c_custkey", None),
    "join_right": ("", f"SELECT a.k AS ak, b.k AS bk, w, v FROM {_A} RIGHT JOIN {_B} ON a.k = b.k", None),
    "join_full": ("", f"SELECT a.k AS ak, b.k AS bk, w, v FROM {_A} FULL OUTER JOIN {_B} ON a.k = b.k", None),
    "join_cross": ("region", "SELECT x.r_name AS p, y.r_name AS q FROM region x CROSS JOIN region y WHERE x.r_regionkey < y.r_regionkey", None),
    "join_using": ("", f"SELECT k, w, v FROM {_A} FULL JOIN {_B} USING (k)", None),
    "join_natural": ("", f"SELECT k, w, v FROM {_A} NATURAL JOIN {_B}", None),
    "join_self": ("nation", "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey", None),
    "join_residual": ("orders lineitem", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice * 5 > o_totalprice GROUP BY o_orderkey", None),
    "join_multi_key": ("supplier customer", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey", None),
    "join_semi_in": ("customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", None),
    "join_anti_not_exists": ("orders lineitem", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", None),
    "not_in_null": ("", f"SELECT k FROM {_A} WHERE k NOT IN (SELECT k FROM {_B})", None),
    "star_join": (
        "lineitem part supplier nation",
        """SELECT n_name, p_brand, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
           JOIN nation ON s_nationkey = n_nationkey WHERE p_size < 10 GROUP BY n_name, p_brand""",
        None,
    ),
    "snowflake_outer": ("nation supplier lineitem", "SELECT n_name, count(l_orderkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY n_name", None),
    # Subqueries.
    "scalar_subquery": ("part", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)", None),
    "corr_scalar_count": ("customer orders", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer", None),
    "corr_scalar_agg": ("lineitem part", "SELECT p_partkey FROM part WHERE p_retailprice < (SELECT max(l_extendedprice) / 50 FROM lineitem WHERE l_partkey = p_partkey)", None),
    "corr_exists_composite": (
        "orders lineitem",
        "SELECT x.l_orderkey, x.l_partkey FROM lineitem x WHERE EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber AND y.l_quantity > 49)",
        None,
    ),
    "exists_projection": ("region orders", "SELECT r_name, EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000000000) AS any_huge FROM region", None),
    "cte_chain": (
        "orders",
        """WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey)
           SELECT p.n, count(*) AS customers FROM per p JOIN per q ON p.o_custkey = q.o_custkey GROUP BY p.n""",
        None,
    ),
    "derived_table": ("orders", "SELECT d.y, max(d.n) AS m FROM (SELECT year(o_orderdate) AS y, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2) d GROUP BY d.y", None),
    "setop_in_subquery": ("supplier customer", "SELECT count(*) AS n FROM (SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer) u WHERE k IN (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer)", None),
    # Aggregation.
    "global_agg": ("orders", "SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders", None),
    "global_agg_empty": ("orders", "SELECT count(*) AS n, min(o_orderkey) AS lo, count(o_custkey) AS c FROM orders WHERE o_orderkey < 0", None),
    "null_group_keys": ("", f"SELECT a, count(*) AS n, count(b) AS c, sum(x) AS s FROM {_G} GROUP BY a", f"SELECT a, count(*) AS n, count(b) AS c, CAST(sum(x) AS DECIMAL(12,1)) AS s FROM {_G} GROUP BY a"),
    "agg_stats": ("part", "SELECT p_brand, round(stddev(p_retailprice), 6) AS sd, round(variance(p_retailprice), 4) AS va, round(var_samp(p_size), 6) AS vs FROM part GROUP BY p_brand", None),
    "agg_pop": ("part", "SELECT p_brand, round(stddev_pop(p_retailprice), 6) AS sd, round(var_pop(p_size), 6) AS va FROM part GROUP BY p_brand", None),
    "agg_median": ("orders", "SELECT o_orderpriority, round(median(o_totalprice), 4) AS m FROM orders GROUP BY o_orderpriority", None),
    "agg_bool": ("part", "SELECT p_brand, bool_and(p_size > 1) AS a, bool_or(p_size > 49) AS o FROM part GROUP BY p_brand", None),
    "agg_distinct": ("lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS c, sum(DISTINCT l_linenumber) AS s, round(avg(DISTINCT l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS c, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, round(avg(DISTINCT l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag"),
    "agg_filter": ("orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 100000) AS d FROM orders GROUP BY o_orderpriority", None),
    "agg_expression": ("lineitem", "SELECT l_linestatus, round(sum(l_extendedprice) / count(*), 4) AS r, round(max(l_quantity) - min(l_quantity), 2) AS spread FROM lineitem GROUP BY l_linestatus", None),
    "group_expression": ("orders", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)", None),
    "having": ("orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000", None),
    "rollup": ("customer", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)", None),
    "rollup_composite": ("lineitem", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, (l_linestatus, l_linenumber))", None),
    "cube": ("", f"SELECT a, b, count(*) AS n FROM {_G} GROUP BY CUBE (a, b)", None),
    "grouping_sets": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None),
    "grouping_id": (
        "lineitem",
        "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
        "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    ),
    "group_keys_only": ("orders", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority", None),
    "distinct": ("events", "SELECT DISTINCT user_id, event_type FROM events", None),
    # Windows.
    "win_rank": ("orders", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", None),
    "win_lag_lead": ("events", "SELECT event_id, lag(event_id) OVER w AS p, lead(event_id, 2, -1) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "win_broadcast": ("events", "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, min(event_id) OVER (PARTITION BY user_id) AS lo FROM events", None),
    "win_running_range": ("orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS n, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS hi FROM orders", None),
    "win_rows_frame": ("events", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM events", None),
    "win_stat_frame": ("events", "SELECT event_id, round(stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS sd, bool_or(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events", None),
    "win_trailing_minmax": ("events", "SELECT event_id, min(event_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS lo, max(event_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING) AS hi FROM events", None),
    "win_median_running": (
        "events",
        "SELECT event_id, round(percentile(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS m FROM events",
        "SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS m FROM events",
    ),
    "win_median": ("events", "SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS m, round(median(value) OVER (PARTITION BY event_type), 6) AS t FROM events", None),
    "win_named": ("events", "SELECT event_id, sum(event_id) OVER w AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)", "SELECT event_id, CAST(sum(event_id) OVER w AS BIGINT) AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"),
    "win_nulls_default": ("", f"SELECT k, w, row_number() OVER (ORDER BY w DESC) AS r, sum(w) OVER (ORDER BY w) AS s FROM {_A}", f"SELECT k, w, row_number() OVER (ORDER BY w DESC NULLS LAST) AS r, CAST(sum(w) OVER (ORDER BY w NULLS LAST) AS BIGINT) AS s FROM {_A}"),
    "win_null_keys": ("", f"SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY w NULLS LAST) AS r FROM {_A}", None),
    "win_expression": ("orders", "SELECT o_orderkey, o_orderkey - min(o_orderkey) OVER (PARTITION BY o_custkey % 10) AS d, sum(o_custkey) OVER (PARTITION BY year(o_orderdate)) AS t FROM orders", "SELECT o_orderkey, o_orderkey - min(o_orderkey) OVER (PARTITION BY o_custkey % 10) AS d, CAST(sum(o_custkey) OVER (PARTITION BY year(o_orderdate)) AS BIGINT) AS t FROM orders"),
    "win_over_aggregate": ("orders", "SELECT o_orderpriority, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY o_orderpriority", None),
    # Order, limit, set operations.
    "order_nulls_last": ("", f"SELECT k, w FROM {_A} ORDER BY k DESC NULLS LAST LIMIT 3", None),
    "order_nulls_default": ("", f"SELECT k, w FROM {_A} ORDER BY k DESC LIMIT 4", f"SELECT k, w FROM {_A} ORDER BY k DESC NULLS LAST LIMIT 4"),
    "offset_only": ("nation", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey OFFSET 20", None),
    "order_expr": ("part", "SELECT p_partkey, row_number() OVER (ORDER BY p_size % 10 DESC, p_retailprice * -1, p_partkey) AS place FROM part ORDER BY p_size % 10 DESC, p_retailprice * -1, p_partkey", None),
    "limit_offset": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 3", None),
    "union_all": ("supplier customer", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer", None),
    "union_distinct": ("supplier customer", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer", None),
    "intersect": ("", f"SELECT k FROM {_A} INTERSECT SELECT k FROM {_B}", None),
    "except": ("", f"SELECT k FROM {_A} EXCEPT SELECT k FROM {_B}", None),
    "intersect_all": ("supplier customer", "SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer", None),
    "except_all": ("supplier customer", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "setop_order_limit": ("supplier customer", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer ORDER BY k DESC LIMIT 5", None),
    # Strings.
    "str_basic": ("part", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS BIGINT) AS n, reverse(p_type) AS r, substr(p_name, 2, 3) AS s, left(p_name, 2) AS lf, right(p_name, 3) AS rt, replace(p_type, 'A', '_') AS rp, repeat(p_brand, 2) AS rr FROM part", None),
    "str_trim_pad": (
        "",
        f"SELECT k, trim(s) AS t, ltrim(s) AS l, rtrim(s) AS r, trim(LEADING 'x' FROM s) AS tl, trim(BOTH 'x' FROM s) AS tb, lpad(s, 6, '*') AS lp, rpad(s, 2, '-') AS rp FROM {_S}",
        f"SELECT k, trim(s) AS t, ltrim(s) AS l, rtrim(s) AS r, ltrim(s, 'x') AS tl, trim(s, 'x') AS tb, lpad(s, 6, '*') AS lp, rpad(s, 2, '-') AS rp FROM {_S}",
    ),
    "str_trim_chars": ("", f"SELECT k, trim(s, 'x') AS b, ltrim(s, 'x ') AS l, rtrim(s, 'jx') AS r FROM {_S}", None),
    "str_concat": ("", f"SELECT k, concat(s, '-', CAST(k AS STRING)) AS c, s || '!' AS p, concat_ws('/', s, CAST(k AS STRING), s) AS w FROM {_S}", f"SELECT k, concat(s, '-', CAST(k AS VARCHAR)) AS c, s || '!' AS p, concat_ws('/', s, CAST(k AS VARCHAR), s) AS w FROM {_S}"),
    "str_position": ("", f"SELECT k, CAST(position('b' IN s) AS BIGINT) AS p, CAST(strpos(s, 'x') AS BIGINT) AS q FROM {_S}", None),
    "str_regex": ("part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '#') AS r, regexp_matches(p_type, 'A.*E') AS m FROM part", None),
    "str_split": ("", f"SELECT k, split_part(s, ',', 1) AS a, split_part(s, ',', -1) AS b, split_part(s, ',', 5) AS c FROM {_S}", None),
    "str_initcap": ("", "SELECT initcap(x) AS i FROM VALUES ('o''neil mc-donald'), ('ABC def'), (CAST(NULL AS STRING)) AS t(x)", "SELECT i FROM (VALUES ('O''Neil Mc-Donald'), ('Abc Def'), (CAST(NULL AS VARCHAR))) t(i)"),
    # Numbers.
    "math_basic": (
        "",
        f"SELECT k, abs(v) AS a, ceil(v) AS c, floor(v) AS f, sign(v) AS sg, round(v, 1) AS r1, trunc(v, 1) AS t1, trunc(v) AS t0, k % 3 AS m, power(k, 2) AS p FROM {_S}",
        f"SELECT k, abs(CAST(v AS DOUBLE)) AS a, ceil(CAST(v AS DOUBLE)) AS c, floor(CAST(v AS DOUBLE)) AS f, CAST(sign(v) AS INT) AS sg, round(CAST(v AS DOUBLE), 1) AS r1, trunc(CAST(v AS DOUBLE) * 10) / 10 AS t1, trunc(CAST(v AS DOUBLE)) AS t0, k % 3 AS m, power(k, 2) AS p FROM {_S}",
    ),
    "math_trig": ("", f"SELECT k, round(sin(k), 9) AS a, round(cos(k), 9) AS b, round(tan(k), 9) AS c, round(asin(k / 10.0), 9) AS d, round(acos(k / 10.0), 9) AS e, round(atan(k), 9) AS f, round(atan2(k, 2), 9) AS g, round(sinh(k), 6) AS h, round(cosh(k), 6) AS i, round(tanh(k), 9) AS j, round(degrees(k), 6) AS l, round(radians(k), 9) AS m, round(pi(), 9) AS n FROM {_S}", None),
    "math_log": ("", f"SELECT k, round(ln(k), 9) AS a, round(log(k), 9) AS b, round(log(2, k), 9) AS c, round(log10(k), 9) AS d, round(log2(k), 9) AS e, round(exp(k), 6) AS f, round(sqrt(k), 9) AS g, round(cbrt(k), 9) AS h FROM {_S}", None),
    # Dates.
    "date_parts": ("orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(extract(DOW FROM o_orderdate) AS BIGINT) AS w, CAST(extract(DOY FROM o_orderdate) AS BIGINT) AS j, CAST(dayofweek(o_orderdate) AS BIGINT) AS dw FROM orders", None),
    "date_time_parts": ("", f"SELECT ts, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(second(ts) AS BIGINT) AS s, extract(EPOCH FROM ts) AS e FROM {_D}", f"SELECT ts, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(second(ts) AS BIGINT) AS s, epoch(ts) AS e FROM {_D}"),
    "date_trunc": ("", f"SELECT date_trunc('year', ts) AS y, date_trunc('month', ts) AS m, date_trunc('day', ts) AS d, date_trunc('hour', ts) AS h, date_trunc('minute', ts) AS mi FROM {_D}", None),
    "date_arith": ("", f"SELECT ts + INTERVAL 1 DAY AS a, ts - INTERVAL 1 MONTH AS b, ts + INTERVAL 1 YEAR AS c, ts + INTERVAL 90 MINUTE AS d, ts + INTERVAL 2 WEEK AS e FROM {_D}", None),
    "date_diff": ("", f"SELECT CAST(datediff('day', CAST(ts AS DATE), d2) AS BIGINT) AS n FROM {_D}", None),
    "date_names": ("", f"SELECT dayname(ts) AS d, monthname(ts) AS m, last_day(CAST(ts AS DATE)) AS l FROM {_D}", None),
    "strftime": ("", f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%b %a %j %y') AS b FROM {_D}", None),
    "date_trunc_second": ("", f"SELECT date_trunc('second', ts) AS s, date_trunc('quarter', ts) AS q, date_trunc('week', ts) AS w FROM {_D}", None),
    "date_diff_units": (
        "",
        f"SELECT datediff('hour', ts, CAST(d2 AS TIMESTAMP)) AS h, datediff('minute', ts, CAST(d2 AS TIMESTAMP)) AS m, datediff('second', ts, CAST(d2 AS TIMESTAMP)) AS s FROM {_D}",
        f"SELECT date_sub('hour', ts, CAST(d2 AS TIMESTAMP)) AS h, date_sub('minute', ts, CAST(d2 AS TIMESTAMP)) AS m, date_sub('second', ts, CAST(d2 AS TIMESTAMP)) AS s FROM {_D}",
    ),
    "date_now": ("orders", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderdate < CURRENT_DATE) AS past, count(*) FILTER (WHERE o_orderdate < NOW() AND NOW() <= CURRENT_TIMESTAMP) AS gone FROM orders", None),
    # Dialect.
    "quoted_names": ("part", """SELECT "p_partkey" AS "part key", p."p_size" AS "size ""in"" cm" FROM "part" AS p WHERE "p_size" > 5 AND p_brand <> 'a"b'""", None),
    "backslash_texts": ("part", r"SELECT p_partkey, 'a\b' || p_brand AS a, '\' AS b, 'it''s \n' AS c, p_name LIKE '%${x}%' AS d, '${x}' AS e FROM part", None),
    "regex_classes": ("part", r"SELECT p_partkey, regexp_matches(p_brand, '#\d\d$') AS a, regexp_matches(p_type, '^promo\b', 'i') AS b, regexp_replace(p_brand, '\d+', '<\0>') AS c FROM part", None),
    "regex_first": (
        "part",
        r"SELECT p_partkey, regexp_replace(p_name, '(\w+) (\w+)', '\2 \1') AS a, regexp_replace(p_type, 'x*', '-') AS b, regexp_replace(p_type, '[A-Z]$', '$') AS c, regexp_replace(p_type, '[AEIOU]', '', 'g') AS d, regexp_replace(p_type, 'e', '_', 'gi') AS e FROM part",
        None,
    ),
    "regex_lookahead": (
        "",
        f"SELECT k, regexp_replace(s, 'b(?=c)', 'X') AS a, regexp_replace(s, '(?<=A)b', 'Y') AS b FROM {_S}",
        f"SELECT k, replace(s, 'bc', 'Xc') AS a, replace(s, 'Ab', 'AY') AS b FROM {_S}",
    ),
    "initcap_letters": (
        "",
        "SELECT x, initcap(x) AS i FROM VALUES ('élan VITAL'), ('o''neil mc-donald'), ('3rd straße 4ab'), ('')  AS t(x)",
        "SELECT x, i FROM (VALUES ('élan VITAL', 'Élan Vital'), ('o''neil mc-donald', 'O''Neil Mc-Donald'), ('3rd straße 4ab', '3Rd Straße 4Ab'), ('', '')) t(x, i)",
    ),
    "decimals": (
        "lineitem",
        "SELECT l_orderkey, CAST(CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS DOUBLE) AS q, CAST(max(CAST(l_tax AS DECIMAL)) AS DOUBLE) AS t FROM lineitem GROUP BY l_orderkey",
        "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS q, CAST(max(l_tax) AS DOUBLE) AS t FROM lineitem GROUP BY l_orderkey",
    ),
    "win_range_numbers": (
        "orders",
        "SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderkey RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS s, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS n FROM orders",
        "SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS n FROM orders",
    ),
    "win_range_days": ("events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS n, max(event_id) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM events", None),
    "qualify_distinct": ("orders", "SELECT DISTINCT o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) <= 2", None),
    "qualify_unselected": ("orders", "SELECT o_orderkey FROM orders QUALIFY o_totalprice = max(o_totalprice) OVER (PARTITION BY o_custkey) AND o_orderstatus <> 'P' ORDER BY o_totalprice DESC", None),
    "qualify_set_arms": (
        "orders",
        """SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1
           UNION ALL SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 ORDER BY 1, 2""",
        None,
    ),
    "qualify_nested": (
        "orders customer",
        """WITH firsts AS (SELECT o_custkey, o_orderkey, rank() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) QUALIFY r + 1 <= 3)
           SELECT c_nationkey, count(*) AS n FROM customer JOIN (SELECT * FROM firsts QUALIFY count(*) OVER (PARTITION BY o_custkey) = 2) f ON c_custkey = f.o_custkey GROUP BY c_nationkey""",
        None,
    ),
    "qualify_grouped": ("orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey QUALIFY rank() OVER (ORDER BY count(*) DESC, o_custkey) <= 20", None),
    "qualify_join": ("customer orders", "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey QUALIFY lag(o.o_orderkey) OVER (PARTITION BY c.c_nationkey ORDER BY o.o_orderkey) IS NULL", None),
    "qualify_topn": ("orders", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2", None),
    "ask_count": ("events", questions.to_sql("how many events per event type", _ASKED), "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "ask_highest": ("orders", questions.to_sql("highest totalprice of orders per orderpriority", _ASKED), "SELECT o_orderpriority, max(o_totalprice) AS max_o_totalprice FROM orders GROUP BY o_orderpriority"),
    "ask_top": ("orders", questions.to_sql("top 5 orders by orderkey", _ASKED), "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5"),
    "qualify_alias": ("events", "SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type = 'purchase' QUALIFY r = 1", None),
}


def _sql_query(tables: str, text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if tables:
            register(spark, sf_dir, *tables.split())
        return dialect.sql(spark, text)

    return run


def queries() -> dict[str, Query]:
    """Every query of SQL and of the write layer."""
    return {name: _sql_query(tables, text) for name, (tables, text, _) in SQL.items()} | write_queries.queries()


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {name: duck or text for name, (_, text, duck) in SQL.items()} | write_queries.oracle_sql()
