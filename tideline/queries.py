"""One query per operator over the dataset tables, in the dialect or the API, with its DuckDB equivalent."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators.upsert import latest
from .plans.mapreduce import Job
from .session import load, register

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = """
SELECT date_trunc('1d', ts) AS d, event_type, count(1) AS c, round(sum(value), 4) AS v FROM events
WHERE ts >= time_at('2024-01-05T00:00:00Z') GROUP BY date_trunc('1d', ts), event_type ORDER BY d, event_type
"""


def _us(unit_us: int, ts: str = "ts") -> str:
    return f"make_timestamp(epoch_us({ts}) - (epoch_us({ts}) % {unit_us}))"


_DAY = 86_400_000_000
#: name -> (dialect, DuckDB)
PAIRS: dict[str, tuple[str, str]] = {
    "ts_rollup": (FLAGSHIP, f"SELECT {_us(_DAY)} AS d, event_type, count(*) AS c, round(sum(value), 4) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1, 2"),
    "scan_project_filter": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45"),
    "select_star": ("SELECT * FROM nation", "SELECT * FROM nation"),
    "qualified_star": ("SELECT n.* FROM nation n WHERE n.n_regionkey = 1", "SELECT * FROM nation WHERE n_regionkey = 1"),
    "qualified_names": ("SELECT nation.n_name AS a, nation.n_nationkey b FROM nation", "SELECT n_name AS a, n_nationkey AS b FROM nation"),
    "select_no_from": ("SELECT 13 + 2 * 5 AS a, 2 ^ 2 ^ 3 AS b, 13 * (8 % 3) + -5 AS c, 7 / 2 AS d", "SELECT 23::BIGINT AS a, 256::BIGINT AS b, 21::BIGINT AS c, 3::BIGINT AS d"),
    "arith_int": ("SELECT l_orderkey, l_linenumber, l_linenumber / 2 AS d, l_linenumber % 2 AS m, l_linenumber + 10 AS a, l_linenumber - 10 AS s, l_linenumber * 3 AS p, -l_linenumber AS n, l_linenumber DIV 3 AS q FROM lineitem", "SELECT l_orderkey, l_linenumber, (l_linenumber // 2)::BIGINT AS d, (l_linenumber % 2)::BIGINT AS m, (l_linenumber + 10)::BIGINT AS a, (l_linenumber - 10)::BIGINT AS s, (l_linenumber * 3)::BIGINT AS p, -l_linenumber AS n, (l_linenumber // 3)::BIGINT AS q FROM lineitem"),
    "arith_float": ("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + 0.00003, 3) AS p, round(l_extendedprice / l_quantity + 0.00003, 3) AS r, round(l_extendedprice % 7.0, 4) AS m FROM lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + 0.00003, 3) AS p, round(l_extendedprice / l_quantity + 0.00003, 3) AS r, round(fmod(l_extendedprice, 7.0), 4) AS m FROM lineitem"),
    "div_by_zero": ("SELECT l_orderkey, l_linenumber, to_string(1.0 / l_discount) = 'Infinity' AS inf FROM lineitem", "SELECT l_orderkey, l_linenumber, l_discount = 0 AS inf FROM lineitem"),
    "power": ("SELECT n_nationkey, n_nationkey ^ 2 AS p, pow(n_nationkey, 3) AS q FROM nation", "SELECT n_nationkey, (n_nationkey ** 2)::BIGINT AS p, (n_nationkey ** 3)::BIGINT AS q FROM nation"),
    "round_truncate": ("SELECT o_orderkey, round(o_totalprice, 1) AS r, round(o_totalprice) AS r0, truncate(o_totalprice, 1) AS t, truncate(-o_totalprice) AS t0 FROM orders", "SELECT o_orderkey, round(o_totalprice, 1) AS r, round(o_totalprice) AS r0, floor(o_totalprice * 10) / 10 AS t, -floor(o_totalprice) AS t0 FROM orders"),
    "bit_ops": ("SELECT n_nationkey, n_nationkey & 5 AS a, n_nationkey | 8 AS o, n_nationkey << 2 AS l, n_nationkey >> 1 AS r, ~n_nationkey AS i FROM nation", "SELECT n_nationkey, n_nationkey & 5 AS a, n_nationkey | 8 AS o, n_nationkey << 2 AS l, n_nationkey >> 1 AS r, ~n_nationkey AS i FROM nation"),
    "compare_all": ("SELECT o_orderkey, o_custkey = 10 AS eq, o_custkey != 10 AS neq, o_custkey < 10 AS lt, o_custkey <= 10 AS lte, o_custkey > 10 AS gt, gte(o_custkey, 10) AS gte, cmp(o_custkey, 10) AS cmp, o_orderstatus == 'F' AS s FROM orders", "SELECT o_orderkey, o_custkey = 10 AS eq, o_custkey <> 10 AS neq, o_custkey < 10 AS lt, o_custkey <= 10 AS lte, o_custkey > 10 AS gt, o_custkey >= 10 AS gte, sign(o_custkey - 10)::BIGINT AS cmp, o_orderstatus = 'F' AS s FROM orders"),
    "bool_logic": ("SELECT event_id, value > 10 AND value < 50 AS a, value < 10 OR value > 50 AS o, NOT value > 10 AS n, logical_and(value > 1, !(value > 2)) AS f FROM events", "SELECT event_id, value > 10 AND value < 50 AS a, value < 10 OR value > 50 AS o, NOT value > 10 AS n, value > 1 AND NOT value > 2 AS f FROM events"),
    "if_expr": ("SELECT event_id, if(value > 10, 'high', 'low') AS level FROM events", "SELECT event_id, CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS level FROM events"),
    "isnull": ("SELECT c.c_custkey AS k, isnull(o.o_orderkey) AS none FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'", "SELECT c_custkey AS k, o_orderkey IS NULL AS none FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'"),
    "str_case": ("SELECT c_custkey, lcase(c_name) AS l, ucase(c_mktsegment) AS u, lowercase(c_mktsegment) AS l2, uppercase(c_name) AS u2 FROM customer", "SELECT c_custkey, lower(c_name) AS l, upper(c_mktsegment) AS u, lower(c_mktsegment) AS l2, upper(c_name) AS u2 FROM customer"),
    "str_prefix_suffix": ("SELECT p_partkey, startswith(p_type, 'PROMO') AS s, endswith(p_type, 'S') AS e FROM part", "SELECT p_partkey, starts_with(p_type, 'PROMO') AS s, suffix(p_type, 'S') AS e FROM part"),
    "str_trim": ("SELECT n_nationkey, ltrim('  ' + n_name + ' ') AS l, rtrim('  ' + n_name + ' ') AS r FROM nation", "SELECT n_nationkey, ltrim('  ' || n_name || ' ') AS l, rtrim('  ' || n_name || ' ') AS r FROM nation"),
    "str_substring": ("SELECT n_nationkey, substring(n_name, 0) AS a, substring(n_name, 3) AS b, substr(n_name, -2) AS c, substring(n_name, 99) AS d, substring(n_name, -99) AS e, substring(n_name, 2, 3) AS f FROM nation", "SELECT n_nationkey, '' AS a, CASE WHEN length(n_name) < 3 THEN n_name[-1:] ELSE substr(n_name, 3) END AS b, n_name[-2:] AS c, n_name[-1:] AS d, '' AS e, substr(n_name, 2, 3) AS f FROM nation"),
    "str_concat": ("SELECT n_nationkey, concat(n_name, '!') AS a, n_name + '-' + n_nationkey AS b FROM nation", "SELECT n_nationkey, n_name || '!' AS a, n_name || '-' || n_nationkey AS b FROM nation"),
    "regexp": ("SELECT p_partkey FROM part WHERE p_type REGEX '^(PROMO|SMALL)' AND NOT p_brand REGEXP '3$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^(PROMO|SMALL)') AND NOT regexp_matches(p_brand, '3$')"),
    "like": ("SELECT p_partkey FROM part WHERE p_type LIKE '%O%' AND p_brand NOT LIKE '%1_'", "SELECT p_partkey FROM part WHERE p_type LIKE '%O%' AND p_brand NOT LIKE '%1_'"),
    "fnv32": ("SELECT n_nationkey, fnv32(n_name) AS h FROM nation", "SELECT n_nationkey, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, length(n_name) + 1), lambda i: ascii(n_name[i])::UBIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)::BIGINT AS h FROM nation"),
    "conv": ("SELECT event_id, to_int64(value) AS i, to_int64(ts) AS us, to_int('12abc') AS l, to_float('1.5x') AS f, to_str(event_id) AS s, to_bool('true') AS b, to_string(ts) AS t, to_timestamp64(event_id) AS z FROM events", "SELECT event_id, trunc(value)::BIGINT AS i, epoch_us(ts) AS us, 12::BIGINT AS l, 1.5::DOUBLE AS f, event_id::VARCHAR AS s, true AS b, epoch_us(ts)::VARCHAR AS t, make_timestamp(event_id) AS z FROM events"),
    "from_timestamp": ("SELECT o_orderkey, from_timestamp(o_orderkey) AS t FROM orders", "SELECT o_orderkey, make_timestamp(o_orderkey * 1000000) AS t FROM orders"),
    "time_at_literal": ("SELECT event_id FROM events WHERE ts < time_at('2024-01-10T12:00:00Z') AND ts >= time_at('1704412800')", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10 12:00:00' AND ts >= TIMESTAMP '2024-01-05'"),
    "agg_global": ("SELECT count(*) AS c, sum(l_linenumber) AS s, round(sum(l_quantity), 2) AS q, min(l_quantity) AS lo, max(l_quantity) AS hi, round(mean(l_quantity), 6) AS m FROM lineitem", "SELECT count(*) AS c, sum(l_linenumber)::BIGINT AS s, round(sum(l_quantity), 2) AS q, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS m FROM lineitem"),
    "agg_empty": ("SELECT count(*) AS c, sum(l_linenumber) AS s FROM lineitem WHERE l_quantity < 0", "SELECT count(*) AS c, sum(l_linenumber)::BIGINT AS s FROM lineitem WHERE l_quantity < 0"),
    "agg_count_distinct": ("SELECT event_type, count_distinct(user_id) AS u, count(value) AS n FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS u, count(value) AS n FROM events GROUP BY event_type"),
    "group_by_col": ("SELECT o_orderstatus, count(1) AS c, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS c, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_orderstatus"),
    "group_by_expr": ("SELECT o_custkey % 8 AS k, count(*) AS c FROM orders GROUP BY o_orderstatus, o_custkey % 8", "SELECT o_custkey % 8 AS k, count(*) AS c FROM orders GROUP BY o_orderstatus, o_custkey % 8"),
    "group_by_bare_col": ("SELECT n.n_nationkey AS k, n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_nationkey", "SELECT n_nationkey AS k, any_value(n_name) AS n_name, any_value(r_name) AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_nationkey"),
    "group_by_star": ("SELECT * FROM (SELECT r_regionkey, r_name FROM region) t GROUP BY r_regionkey ORDER BY r_regionkey", "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey"),
    "agg_in_expr": ("SELECT event_type, round(sum(value) / count(1), 4) + 1 AS a FROM events GROUP BY event_type", "SELECT event_type, round(sum(value) / count(*), 4) + 1 AS a FROM events GROUP BY event_type"),
    "having": ("SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND o_custkey > 5", "SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND o_custkey > 5"),
    "join_inner_equi": ("SELECT o.o_orderkey AS k, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT o_orderkey AS k, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_where_equi": ("SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name != 'ASIA'", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'"),
    "join_theta": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"),
    "join_cross": ("SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r", "SELECT n_name, r_name FROM nation CROSS JOIN region"),
    "join_left": ("SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000"),
    "join_right": ("SELECT c.c_custkey AS k, o.o_orderkey AS o FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey", "SELECT c_custkey AS k, o_orderkey AS o FROM orders RIGHT JOIN customer ON c_custkey = o_custkey"),
    "join_natural": ("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y", "SELECT n_nationkey AS k, n_name AS a, s_name AS b FROM nation JOIN supplier ON n_nationkey = s_nationkey"),
    "join_natural_left": ("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL LEFT JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y", "SELECT n_nationkey AS k, n_name AS a, s_name AS b FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey"),
    "join_using": ("SELECT o_orderkey, o_totalprice, q FROM orders JOIN (SELECT l_orderkey AS o_orderkey, l_quantity AS q FROM lineitem) l USING (o_orderkey)", "SELECT o_orderkey, o_totalprice, l_quantity AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "join_multiway": ("SELECT r.r_name AS region, count(*) AS c, round(sum(o.o_totalprice), 2) AS t FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name", "SELECT r_name AS region, count(*) AS c, round(sum(o_totalprice), 2) AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "join_left_where": ("SELECT c.c_custkey AS k FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 450000 WHERE o.o_orderkey IS NULL", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)"),
    "subquery_from": ("SELECT k, c + 1 AS c1 FROM (SELECT o_custkey AS k, count(*) AS c FROM orders GROUP BY o_custkey) t", "SELECT o_custkey AS k, count(*) + 1 AS c1 FROM orders GROUP BY o_custkey"),
    "subquery_filter": ("SELECT k FROM (SELECT o_custkey AS k, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) t WHERE m > 400000", "SELECT o_custkey AS k FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 400000"),
    "order_multi": ("SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey DESC, s_suppkey", "SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey DESC, s_suppkey"),
    "order_expr_unselected": ("SELECT c_custkey FROM customer ORDER BY c_acctbal * -1, c_custkey", "SELECT c_custkey FROM customer ORDER BY c_acctbal * -1, c_custkey"),
    "order_alias": ("SELECT c_custkey AS k, c_acctbal * 2 AS b FROM customer ORDER BY b DESC, k", "SELECT c_custkey AS k, c_acctbal * 2 AS b FROM customer ORDER BY b DESC, k"),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 20", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 20"),
    "limit_comma": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20, 5", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 20"),
    "union_all": ("SELECT event_id, value FROM events WHERE value < 5 UNION ALL SELECT event_id, value FROM events WHERE value < 10", "SELECT event_id, value FROM events WHERE value < 5 UNION ALL SELECT event_id, value FROM events WHERE value < 10"),
    "union_order_limit": ("SELECT c_nationkey AS k, c_custkey AS i FROM customer UNION ALL SELECT s_nationkey AS k, s_suppkey AS i FROM supplier ORDER BY i DESC, k LIMIT 12", "SELECT c_nationkey AS k, c_custkey AS i FROM customer UNION ALL SELECT s_nationkey AS k, s_suppkey AS i FROM supplier ORDER BY i DESC, k LIMIT 12"),
    "union_mixed": ("SELECT s_nationkey AS k FROM supplier UNION SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region", "SELECT s_nationkey AS k FROM supplier UNION SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region"),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier"),
    "to_nil": ("SELECT event_id, isnull(to_nil(value)) AS n FROM events", "SELECT event_id, true AS n FROM events"),
    "multi_statement": ("SELECT 1 AS a; SELECT count(*) AS c FROM region;", "SELECT count(*) AS c FROM region"),
    "timewindow": ("SELECT time, c, s FROM (SELECT ts AS time, count(*) AS c, round(sum(value), 4) AS s FROM events GROUP OVER TIMEWINDOW(ts, 604800, 86400)) t", """WITH s AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events),
        g AS (SELECT a + i * 86400000000 AS w FROM s, range(0, ((b - a - 518400000000) // 86400000000) + 1) AS r(i))
        SELECT make_timestamp(w + 518400000000) AS time, count(value) AS c, round(sum(value), 4) AS s FROM g LEFT JOIN events ON epoch_us(ts) >= w AND epoch_us(ts) < w + 604800000000 GROUP BY w"""),
    "timewindow_by": ("SELECT ts AS time, event_type, round(mean(value) + 0.00003, 3) AS m, max(value) AS hi FROM events GROUP OVER TIMEWINDOW(ts, 259200, 86400) BY event_type", """WITH s AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events), k AS (SELECT DISTINCT event_type FROM events),
        g AS (SELECT a + i * 86400000000 AS w, event_type FROM s, range(0, ((b - a - 172800000000) // 86400000000) + 1) AS r(i), k)
        SELECT make_timestamp(w + 172800000000) AS time, g.event_type, round(avg(value) + 0.00003, 3) AS m, max(value) AS hi FROM g LEFT JOIN events e ON epoch_us(ts) >= w AND epoch_us(ts) < w + 259200000000 AND e.event_type = g.event_type GROUP BY w, g.event_type"""),
    "timewindow_having": ("SELECT ts AS time, event_type, count(*) AS c FROM events GROUP OVER TIMEWINDOW(ts, 172800, 86400) BY event_type HAVING count(*) % 2 = 0", """WITH s AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events), k AS (SELECT DISTINCT event_type FROM events),
        g AS (SELECT a + i * 86400000000 AS w, event_type FROM s, range(0, ((b - a - 86400000000) // 86400000000) + 1) AS r(i), k)
        SELECT make_timestamp(w + 86400000000) AS time, g.event_type, count(value) AS c FROM g LEFT JOIN events e ON epoch_us(ts) >= w AND epoch_us(ts) < w + 172800000000 AND e.event_type = g.event_type GROUP BY w, g.event_type HAVING count(value) % 2 = 0 AND count(value) > 0"""),
    "timewindow_join": ("SELECT a.t AS time, count(a.event_id) AS e, max(b.o_totalprice) AS p FROM (SELECT ts AS t, event_id FROM events) a, (SELECT o_orderdate AS t, o_totalprice FROM orders) b GROUP OVER TIMEWINDOW(a.t, 7776000)", """WITH s AS (SELECT min(t) AS a, max(t) AS b FROM (SELECT epoch_us(ts) AS t FROM events UNION ALL SELECT epoch_us(o_orderdate) FROM orders)),
        g AS (SELECT a + i * 7776000000000 AS w FROM s, range(0, ((b - a) // 7776000000000) + 1) AS r(i)),
        x AS (SELECT w, count(*) AS e FROM g JOIN events ON epoch_us(ts) >= w AND epoch_us(ts) < w + 7776000000000 GROUP BY w), y AS (SELECT w, max(o_totalprice) AS p FROM g JOIN orders ON epoch_us(o_orderdate) >= w AND epoch_us(o_orderdate) < w + 7776000000000 GROUP BY w)
        SELECT make_timestamp(g.w) AS time, e, p FROM g LEFT JOIN x ON g.w = x.w LEFT JOIN y ON g.w = y.w"""),
    "timewindow_self_join": ("SELECT a.ts AS time, sum(a.value) / count(b.value) > 50 AS high FROM events a, events b GROUP OVER TIMEWINDOW(a.ts, 86400)", """WITH s AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events),
        g AS (SELECT a + i * 86400000000 AS w FROM s, range(0, ((b - a) // 86400000000) + 1) AS r(i))
        SELECT make_timestamp(w) AS time, sum(value) / count(value) > 50 AS high FROM g LEFT JOIN events ON epoch_us(ts) >= w AND epoch_us(ts) < w + 86400000000 GROUP BY w"""),
    "within_record_sum": ("SELECT vec_id, round(sum(embedding) WITHIN RECORD, 4) AS s, count(embedding) WITHIN RECORD AS n, max(embedding) WITHIN RECORD AS hi FROM embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS s, len(embedding) AS n, list_max(embedding) AS hi FROM embeddings"),
    "repeated_explode": ("SELECT vec_id, embedding FROM embeddings", "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings"),
}
for _name, _units in {"ms": 1_000, "10min": 600_000_000, "5h": 18_000_000_000, "1d": _DAY, "1w": 7 * _DAY, "month": 30 * _DAY, "2years": 730 * _DAY}.items():
    PAIRS[f"date_trunc_{_name}"] = (f"SELECT event_id, date_trunc('{_name}', ts) AS t FROM events", f"SELECT event_id, {_us(_units)} AS t FROM events")
for _fn, _sign in (("date_add", "+"), ("date_sub", "-")):
    for _expr, _unit, _k in (("10", "SECOND", 10), ("1.5", "hour", 5400), ("10:10", "MINUTE_SECOND", 610), ("01:10", "HOUR_MINUTE", 4200), ("01:10:10", "HOUR_SECOND", 4210), ("2 12:30:10", "DAY_SECOND", 217810), ("2 12:30", "DAY_MINUTE", 217800), ("2 12", "DAY_HOUR", 216000), ("1-2", "YEAR_MONTH", 36720000)):
        PAIRS[f"{_fn}_{_unit.lower()}"] = (f"SELECT event_id, {_fn}(ts, '{_expr}', '{_unit}') AS t FROM events", f"SELECT event_id, make_timestamp(epoch_us(ts) {_sign} {_k * 1_000_000}) AS t FROM events")


def engine(spark: SparkSession, folder: str) -> Engine:
    return Engine(spark, folder)


def _dialect(text: str) -> Query:
    return lambda spark, folder: engine(spark, folder).sql(text)


def record_field(spark: SparkSession, folder: str) -> DataFrame:
    """Dotted names into a repeated record, one row per value."""
    e = engine(spark, folder)
    items = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"))).alias("items"))
    items.createOrReplaceTempView("order_records")
    return e.sql("SELECT l_orderkey, items.line AS line, items.qty AS qty FROM order_records WHERE items.qty > 25")


def record_within(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder)
    items = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"))).alias("items"))
    items.createOrReplaceTempView("order_records")
    return e.sql("SELECT l_orderkey, round(sum(items.qty) WITHIN RECORD, 4) AS s, count(items.line) WITHIN RECORD AS n, sum(items.line) WITHIN RECORD AS lines FROM order_records")


def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Each event twice, the second time with a doubled value: the later version stays."""
    e = load(spark, folder, "events").select("event_id", "value")
    both = e.withColumn("v", F.lit(1)).union(e.filter("event_id % 2 = 0").select("event_id", F.col("value") * 2, F.lit(2)))
    return latest(both, ["event_id"], ["v"]).select("event_id", "value")


def insert_json(spark: SparkSession, folder: str) -> DataFrame:
    """JSON objects to rows."""
    return load(spark, folder, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def mapreduce_wordcount(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder)
    words = e.map_table("documents", lambda r: [(w, 1) for w in (r["text"] or "").split()], ["text"])
    count = lambda k, vs: [(k, sum(map(int, vs)))]
    done = e.reduce(words, count, combine_fn=count)
    return done.pairs.select(F.col("key").alias("word"), F.col("value").cast("bigint").alias("n"))


def mapreduce_join(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder)
    orders = e.map_table("orders", lambda r: [(r["o_orderkey"], {"status": r["o_orderstatus"]})], ["o_orderkey", "o_orderstatus"])
    lines = e.reduce(e.map_table("lineitem", lambda r: [(r["l_orderkey"], 1)], ["l_orderkey"]), lambda k, vs: [(k, {"lines": sum(1 for _ in vs)})])
    out = e.mapreduce.join([orders, lines]).pairs
    got = F.from_json("value", "status string, lines bigint")
    return out.select(F.col("key").cast("bigint").alias("k"), got["status"].alias("status"), got["lines"].alias("lines"))


def mapreduce_multi_source(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder)
    jobs = [e.map_table(t, lambda r: [(next(iter(r.values())), 1)], [c]) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    done = e.reduce(jobs, lambda k, vs: [(k, sum(map(int, vs)))])
    return done.pairs.select(F.col("key").cast("int").alias("k"), F.col("value").cast("bigint").alias("n"))


def mapreduce_graph(spark: SparkSession, folder: str) -> DataFrame:
    """A job graph in its JSON form."""
    e = engine(spark, folder)
    tasks = json.loads('[{"id": "m", "op": "map_table", "table_name": "events", "map_fn": "m", "required_columns": ["event_type", "user_id"]}, {"id": "r", "op": "reduce", "sources": ["m"], "reduce_fn": "r", "num_shards": 4}]')
    made: dict[str, Job] = e.mapreduce.run(tasks, {"m": lambda r: [(r["event_type"], r["user_id"])], "r": lambda k, vs: [(k, max(map(int, vs)))]})
    return made["r"].pairs.select(F.col("key").alias("event_type"), F.col("value").cast("bigint").alias("top"))


def now_shape(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder).sql("SELECT r_regionkey, now() > time_at('2020-01-01') AS later, version() AS v FROM region")


def show_tables(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, ("nation", "orders"))
    return Engine(spark).sql("SHOW TABLES")


def describe_table(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, ("nation", "orders"))
    return Engine(spark).sql("DESCRIBE TABLE orders")


def show_servers(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder).sql("DESCRIBE SERVERS")


def explain(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder).sql("EXPLAIN SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")


def draw_linechart(spark: SparkSession, folder: str) -> DataFrame:
    """A chart of daily event counts by type, as one SVG cell."""
    chart = engine(spark, folder).sql("DRAW LINECHART AXIS BOTTOM AXIS LEFT GRID HORIZONTAL LEGEND TOP RIGHT INSIDE; SELECT event_type AS series, date_trunc('1d', ts) AS x, count(1) AS y FROM events GROUP BY event_type, date_trunc('1d', ts) ORDER BY x")
    return chart.to_dataframe(spark)


def codec_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells as the result codecs print them."""
    from .codecs import printed

    return printed(load(spark, folder, "events").select("event_id", "ts", "event_type")).toDF("event_id", "ts", "event_type")


def _fresh(spark: SparkSession, folder: str, name: str, columns: str) -> Engine:
    """An engine with an empty table of that name; one that an earlier run left is dropped."""
    e = engine(spark, folder)
    if spark.catalog.tableExists(name):
        e.drop_table(name)
    e.sql(f"CREATE TABLE {name} ({columns})")
    return e


_VIEWS = "time datetime, event_id uint64, event_type string, value double, PRIMARY KEY(time, event_id), PARTITION KEY(time)"


def table_insert(spark: SparkSession, folder: str) -> DataFrame:
    """CREATE TABLE, INSERT, and a second INSERT that replaces a row of the same key."""
    e = _fresh(spark, folder, "catalogue_insert", "time datetime, sid uint64 NOT NULL, url string, PRIMARY KEY(time, sid), PARTITION KEY(time)")
    e.sql("INSERT INTO catalogue_insert (time, sid, url) VALUES ('2017-01-01T12:00:00Z', 1, '/a'), (time_at('2017-01-02T00:00:01Z'), 1 + 1, concat('/', 'b')); INSERT INTO catalogue_insert (time, sid) VALUES ('2017-01-01T12:00:00Z', 1)")
    return e.sql("SELECT * FROM catalogue_insert")


def table_insert_json(spark: SparkSession, folder: str) -> DataFrame:
    e = _fresh(spark, folder, "catalogue_json", "k uint64, m REPEATED RECORD(thing string, temp double), PRIMARY KEY(k)")
    e.sql("""INSERT INTO catalogue_json FROM JSON '{"k":9,"m":[{"thing":"a","temp":22.3},{"thing":"b","temp":21.8}]}'; INSERT INTO catalogue_json FROM JSON '{"k":10,"m":[{"thing":"c","temp":1.5}]}'""")
    return e.sql("SELECT k, m.thing AS thing, m.temp AS temp FROM catalogue_json")


def table_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """All events into a keyed table, then those with even ids again with a doubled value."""
    e = _fresh(spark, folder, "catalogue_upsert", _VIEWS)
    events = load(spark, folder, "events").select(F.col("ts").alias("time"), "event_id", "event_type", "value")
    e.upsert("catalogue_upsert", events)
    e.upsert("catalogue_upsert", events.filter("event_id % 2 = 0").withColumn("value", F.col("value") * 2))
    return e.sql("SELECT event_id, value FROM catalogue_upsert")


def table_compact(spark: SparkSession, folder: str) -> DataFrame:
    """The same after compaction, bounded by the partition key, so that other days stay unread."""
    e = _fresh(spark, folder, "catalogue_compact", _VIEWS)
    events = load(spark, folder, "events").select(F.col("ts").alias("time"), "event_id", "event_type", "value")
    e.upsert("catalogue_compact", events)
    e.upsert("catalogue_compact", events.filter("event_id % 2 = 0").withColumn("value", F.col("value") * 2))
    e.tables.compact("catalogue_compact")
    return e.sql("SELECT event_id, value FROM catalogue_compact WHERE time >= time_at('2024-01-03') AND time < time_at('2024-01-05T06:00:00Z')")


def table_alter(spark: SparkSession, folder: str) -> DataFrame:
    e = _fresh(spark, folder, "catalogue_alter", "k uint64, a string, r RECORD(x double), PRIMARY KEY(k)")
    e.sql("INSERT INTO catalogue_alter (k, a) VALUES (1, 'x'); ALTER TABLE catalogue_alter ADD COLUMN b double, DROP a, ADD COLUMN r.y string; ALTER TABLE catalogue_alter SET PROPERTY partition_size_hint = 5")
    return e.sql("DESCRIBE TABLE catalogue_alter").select("column_name", "type", "nullable", "primary_key")


def describe_partitions(spark: SparkSession, folder: str) -> DataFrame:
    e = _fresh(spark, folder, "catalogue_days", _VIEWS)
    e.upsert("catalogue_days", load(spark, folder, "events").select(F.col("ts").alias("time"), "event_id"))
    return e.sql("DESCRIBE PARTITIONS catalogue_days").select("partition_id", "rows")


def import_csv(spark: SparkSession, folder: str) -> DataFrame:
    """IMPORT of a CSV file with a header, written for the purpose."""
    path = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:").rstrip("/") + "/catalogue_nations.csv"
    load(spark, folder, "nation").select("n_nationkey", "n_name").write.mode("overwrite").csv(path, header=True, sep=";")
    e = engine(spark, folder)
    e.sql(f"IMPORT TABLE catalogue_nations FROM 'csv://{path}?headers=true&col_sep=%3B'")
    return e.sql("SELECT to_int(n_nationkey) AS k, n_name FROM catalogue_nations")


def _derby(spark: SparkSession, df: DataFrame, table: str) -> str:
    """The JDBC address, less its scheme, of a database with ``df`` as ``table`` that the driver and all executors can read at once.

    A Derby database that can be written belongs to one process. So executors
    write the rows as delimited text into the warehouse, from where the driver's
    Derby imports them in bulk. It is then closed and put into the warehouse as
    one file, which every process opens for reading. Its entries are stored
    uncompressed, so that a page is found without those before it. The file goes
    with the driver's process.
    """
    home = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"))
    home.mkdir(parents=True, exist_ok=True)
    name = f"{home}/catalogue-{uuid.uuid4().hex[:12]}"
    # Nothing between commas is null, "" an empty string.
    cells = [F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) if kind == "string" else F.col(c).cast("string"), F.lit("")) for c, kind in df.dtypes]
    df.select(F.concat_ws(",", *cells)).write.text(f"{name}.csv")
    connect = spark._jvm.java.sql.DriverManager.getConnection
    with tempfile.TemporaryDirectory() as made:
        base = Path(os.path.realpath(made))
        url = f"jdbc:derby:{base}/catalogue"
        df.limit(0).write.jdbc(f"{url};create=true", table)  # has no partitions, so that no executor connects
        held = connect(url)
        call = held.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(null, ?, ?, ',', '\"', 'UTF-8', 0)")
        call.setString(1, table.upper())
        for part in Path(f"{name}.csv").glob("part-*"):
            call.setString(2, str(part))
            call.execute()
        held.close()
        shutil.rmtree(f"{name}.csv")
        try:
            connect(f"{url};shutdown=true")
        except Py4JJavaError as e:
            if e.java_exception.getSQLState() != "08006":  # closed
                raise
        atexit.register(Path(f"{name}.jar").unlink, missing_ok=True)
        with zipfile.ZipFile(f"{name}.jar", "w", zipfile.ZIP_STORED) as z:
            for p in (base / "catalogue").rglob("*"):
                z.write(p, p.relative_to(base))
    return f"derby:jar:({name}.jar)catalogue"


def import_database(spark: SparkSession, folder: str) -> DataFrame:
    """IMPORT over JDBC in parallel ranges, with a filter, from a database that is filled for the purpose."""
    suppliers = load(spark, folder, "supplier").select(*[F.col(c).alias(c.upper()) for c in ("s_suppkey", "s_name", "s_nationkey")])
    address = _derby(spark, suppliers, "catalogue_suppliers")
    e = engine(spark, folder)
    e.sql(f"IMPORT TABLE catalogue_suppliers FROM 'jdbc://{address}?column=s_suppkey&partitions=4&filter=s_nationkey%20%3E%203'")
    return e.sql("SELECT s_suppkey AS s_suppkey, s_name AS s_name, s_nationkey AS s_nationkey FROM catalogue_suppliers")


def mapreduce_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Two reductions of one kept map step."""
    e = engine(spark, folder)
    make = lambda r: [(r["event_type"], r["event_id"])]
    one, two = (e.map_table("events", make, ["event_type", "event_id"], keep=True) for _ in range(2))
    low = e.reduce(one, lambda k, vs: [(f"{k} low", min(map(int, vs)))])
    high = e.reduce(two, lambda k, vs: [(f"{k} high", max(map(int, vs)))])
    return low.pairs.union(high.pairs).select(F.col("key").alias("k"), F.col("value").cast("bigint").alias("v"))


def user_functions(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder)
    e.register_function("twice", lambda x: x * 2)
    e.register_aggregate("spread", lambda x: F.max(x) - F.min(x))
    return e.sql("SELECT event_type, twice(spread(event_id)) AS s FROM events GROUP BY event_type")


def mapreduce_save(spark: SparkSession, folder: str) -> DataFrame:
    """The result of a reduce step saved to a keyed table."""
    e = _fresh(spark, folder, "catalogue_sums", "k string, n uint64, PRIMARY KEY(k)")
    count = lambda k, vs: [(k, sum(map(int, vs)))]
    counted = e.reduce(e.map_table("events", lambda r: [(r["event_type"], 1)], ["event_type"]), lambda k, vs: [(k, {"k": k, "n": sum(map(int, vs))})], combine_fn=count)
    e.mapreduce.save_to_table(counted, "catalogue_sums")
    return e.sql("SELECT * FROM catalogue_sums")


FRAMES: dict[str, Query] = {f.__name__: f for f in (table_insert, table_insert_json, table_upsert, table_compact, table_alter, describe_partitions, import_csv, import_database, user_functions, mapreduce_save, mapreduce_kept, record_field, record_within, upsert_latest, insert_json, mapreduce_wordcount, mapreduce_join, mapreduce_multi_source, mapreduce_graph, now_shape, show_tables, describe_table, show_servers, explain, draw_linechart, codec_cells)}
QUERIES: dict[str, Query] = {name: _dialect(text) for name, (text, _) in PAIRS.items()} | FRAMES
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in PAIRS.items()} | {
    "record_field": "SELECT l_orderkey, l_linenumber AS line, l_quantity AS qty FROM lineitem WHERE l_quantity > 25",
    "record_within": "SELECT l_orderkey, round(sum(l_quantity), 4) AS s, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY l_orderkey",
    "upsert_latest": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value * 2 ELSE value END AS value FROM events",
    "insert_json": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "table_insert": "SELECT * FROM (VALUES (TIMESTAMP '2017-01-01 12:00:00', 1, NULL), (TIMESTAMP '2017-01-02 00:00:01', 2, '/b')) t(time, sid, url)",
    "table_insert_json": "SELECT * FROM (VALUES (9, 'a', 22.3::DOUBLE), (9, 'b', 21.8::DOUBLE), (10, 'c', 1.5::DOUBLE)) t(k, thing, temp)",
    "table_upsert": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value * 2 ELSE value END AS value FROM events",
    "table_compact": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value * 2 ELSE value END AS value FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05 06:00:00'",
    "table_alter": "SELECT * FROM (VALUES ('k', 'UINT64', 'YES', 'YES'), ('r', 'RECORD', 'YES', 'NO'), ('b', 'DOUBLE', 'YES', 'NO')) t(column_name, type, nullable, primary_key)",
    "describe_partitions": "SELECT strftime(ts, '%Y-%m-%d') AS partition_id, count(*) AS rows FROM events GROUP BY 1",
    "import_csv": "SELECT n_nationkey::BIGINT AS k, n_name FROM nation",
    "import_database": "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_nationkey > 3",
    "mapreduce_kept": "SELECT event_type || ' low' AS k, min(event_id) AS v FROM events GROUP BY event_type UNION ALL SELECT event_type || ' high', max(event_id) FROM events GROUP BY event_type",
    "user_functions": "SELECT event_type, 2 * (max(event_id) - min(event_id)) AS s FROM events GROUP BY event_type",
    "mapreduce_save": "SELECT event_type AS k, count(*) AS n FROM events GROUP BY event_type",
    "mapreduce_wordcount": "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\\s]+')) AS word FROM documents) GROUP BY word",
    "mapreduce_join": "SELECT coalesce(o_orderkey, l_orderkey) AS k, o_orderstatus AS status, lines FROM orders FULL JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey",
    "mapreduce_multi_source": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k",
    "mapreduce_graph": "SELECT event_type, max(user_id) AS top FROM events GROUP BY event_type",
    "now_shape": "SELECT r_regionkey, true AS later, '1.0' AS v FROM region",
    "codec_cells": "SELECT event_id::VARCHAR AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type FROM events",
}
