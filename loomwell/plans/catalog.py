"""The registered queries and, for each, the SQL that an independent engine runs.

Relational operators are SQL over the tables as they are. Log operators run
over the ``events`` table read as object logs: the object is the user, seq
counts a user's events, an ``error`` event did not commit, a purchase is a
debit and any other event a credit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwell.engine import Engine, UserError
from loomwell.functions import scalar
from loomwell.operators import audits, grants, log, placement, polls, txn, wills
from loomwell.sources import blobs
from loomwell.sources.shared import scratch
from loomwell.streaming import live


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, args: dict | None = None) -> DataFrame:
    """Spark SQL over the tables that the text names."""
    for t in TABLES:
        if t in text:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text, args=args) if args else spark.sql(text)


#: The event log as SQL, for both engines.
LOG_SQL = (
    "log AS (SELECT concat('u', cast(user_id AS {str})) AS object, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id, event_type, "
    "CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * cast(round(value * 100) AS BIGINT) AS amt, event_type <> 'error' AS ok FROM events)"
)
SPARK_LOG, DUCK_LOG = LOG_SQL.format(str="STRING"), LOG_SQL.format(str="VARCHAR")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object, seq, txn, born, kind, payload, ok, amt."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    sign = F.when(F.col("event_type") == "purchase", -1).otherwise(1)
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("object"),
        F.row_number().over(w).cast("long").alias("seq"),
        F.col("event_id").alias("txn"),
        F.col("event_id").alias("born"),
        F.when(F.col("event_type") == "signup", "snapshot").otherwise("delta").alias("kind"),
        F.col("event_type").alias("payload"),
        (F.col("event_type") != "error").alias("ok"),
        (sign * F.round(F.col("value") * 100).cast("long")).alias("amt"),
    )


def outcomes(entries: DataFrame) -> DataFrame:
    """A row for each settled transaction; one in seven of the failed is still pending."""
    return entries.filter("ok or txn % 7 <> 0").select("txn", F.col("ok").alias("committed"))


def tx_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(txn, object): orders and the parts that they take one of."""
    return table(spark, sf_dir, "lineitem").filter("l_quantity = 1").select(F.col("l_orderkey").alias("txn"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("object")).distinct()


def trace_hash(events: DataFrame) -> DataFrame:
    """user_id, hash: FNV over a user's events in order; the running hash is that of the concatenation."""
    trace = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), "")
    return events.groupBy("user_id").agg(trace.alias("t")).select("user_id", scalar.fnv1a64(F.col("t")).cast("string").alias("hash"))


#: SQL of the operators that need no code: the same text for both engines, or one text for each.
BOTH: dict[str, str] = {
    "sc1_object_scan": "SELECT event_id, event_type FROM events WHERE user_id = 7",
    "sc12_list_objects": "SELECT DISTINCT user_id AS object FROM events",
    "sc14_values": "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)",
    "pr1_projection": "SELECT o_orderkey AS k, o_orderstatus, 1 AS one FROM orders",
    "pr2_arithmetic": "SELECT l_orderkey, l_linenumber, cast(l_quantity AS BIGINT) * 2 - l_linenumber AS x, -l_linenumber AS neg FROM lineitem",
    "pr3_filter": "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 5 AND l_discount > 0.05 AND l_returnflag = 'R'",
    "pr4_in_subquery": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "pr5_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "pr6_scalar_subqueries": "SELECT (SELECT count(*) FROM orders) AS orders_n, (SELECT max(c_custkey) FROM customer) AS last_customer",
    "pr8_comments": "SELECT n_name -- the name\nFROM nation WHERE n_regionkey = 2",
    "pr11_between_case": "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size IN (20, 30) THEN 'round' ELSE 'other' END AS c FROM part",
    "pr11_is_distinct": "SELECT count(*) AS n FROM events WHERE event_type IS DISTINCT FROM 'view'",
    "jn1_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'",
    "jn1_using": "SELECT a.user_id, count(*) AS n FROM events a JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') b USING (user_id) GROUP BY a.user_id",
    "jn2_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "jn2_right": "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "jn2_full": "SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) a FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey) b ON a.k = b.k",
    "jn3_cross": "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b",
    "jn4_theta": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "jn5_semi": "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50)",
    "jn6_self": "SELECT a.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id = a.event_id + 1",
    "jn6_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "jn7_temp_and_main": "WITH typing AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') SELECT (SELECT count(*) FROM typing) AS typing_n, (SELECT count(*) FROM events) AS events_n",
    "ag1_count": "SELECT count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events",
    "ag2_max_coalesce": "SELECT coalesce(max(event_id), 0) AS last_id FROM events WHERE user_id < 0",
    "ag3_sum": "SELECT user_id, cast(sum(cast(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY user_id",
    "ag4_counters": "SELECT user_id % 16 AS worker, count(*) AS n, count(DISTINCT user_id) AS objects FROM events GROUP BY user_id % 16",
    "ag5_having_distinct": "SELECT l_partkey, count(DISTINCT l_suppkey) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_partkey HAVING count(*) > 20",
    "ag5_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus <> 'F') AS other FROM orders GROUP BY o_orderpriority",
    "ag7_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "ag7_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "ag9_pricing_summary": "SELECT l_returnflag, l_linestatus, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS qty, cast(sum(cast(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "wn1_ranks": "SELECT event_id, cast(row_number() OVER w AS BIGINT) AS rn, cast(rank() OVER w AS BIGINT) AS rk, cast(dense_rank() OVER w AS BIGINT) AS dr, cast(ntile(4) OVER w AS BIGINT) AS nt FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)",
    "wn1_percent": "SELECT n_nationkey, percent_rank() OVER (ORDER BY n_regionkey) AS pr, cume_dist() OVER (ORDER BY n_regionkey) AS cd FROM nation",
    "wn1_lag_lead": "SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id, 2) OVER w AS next2, first_value(event_id) OVER w AS first_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "wn1_last_nth": "SELECT event_id, last_value(event_id) OVER w AS last_id, nth_value(event_id, 2) OVER w AS second_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "wn2_frames": "SELECT event_id, cast(sum(cast(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s3, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near FROM events",
    "so1_order_nulls": "SELECT event_id, event_type FROM events ORDER BY event_type NULLS FIRST, event_id",
    "so3_offset": "SELECT event_id FROM events ORDER BY event_id LIMIT 10 OFFSET 20",
    "st1_union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "st1_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "st1_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "st1_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000",
    "ct1_cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM big GROUP BY n",
    "ct2_recursive": "WITH RECURSIVE r(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 10) SELECT n, f FROM r",
    "dm2_insert_once": "SELECT user_id AS k FROM events WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal > 5000) GROUP BY user_id",
    "dm3_insert_or_ignore": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) t WHERE rn = 1",
    "dm4_upsert": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) t WHERE rn = 1",
    "dm5_update": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN cast(round(c_acctbal * 100) AS BIGINT) + 100 ELSE cast(round(c_acctbal * 100) AS BIGINT) END AS cents FROM customer",
    "dm6_delete": "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')",
    "dm7_claim": "SELECT user_id AS k, min(event_id) AS winner FROM events WHERE event_type = 'click' GROUP BY user_id",
    "fn1_null_functions": "SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS a, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS b FROM events",
    "fn2_strings": "SELECT n_name, cast(length(n_name) AS BIGINT) AS len, upper(n_name) AS up, lower(n_name) AS lo, substr(n_name, 2, 3) AS sub, replace(n_name, 'A', '_') AS rep, cast(instr(n_name, 'A') AS BIGINT) AS at, trim(concat(' ', n_name)) AS tr FROM nation",
    "fn3_math": "SELECT p_partkey, abs(p_size - 25) AS a, cast(sign(p_size - 25) AS INT) AS s, cast(floor(p_size / 7.0) AS BIGINT) AS f, cast(ceil(p_size / 7.0) AS BIGINT) AS c, p_size % 7 AS m, power(p_size, 2) AS sq FROM part",
    "fn4_bits": "SELECT p_partkey, p_size & 7 AS a, p_size | 8 AS o, ~p_size AS n FROM part",
    "jn1_natural": "SELECT count(*) AS n FROM nation NATURAL JOIN (SELECT n_nationkey, n_regionkey AS rk FROM nation) t",
    "jn3_comma": "SELECT a.r_name AS a, b.n_name AS b FROM region a, nation b WHERE a.r_regionkey = b.n_regionkey",
    "jn4_range": "SELECT a.user_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id AND b.event_id <= a.event_id + 500 GROUP BY a.user_id",
    "pr11_row_values": "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '5-LOW'))",
    "so3_nocase": "SELECT c_custkey, lower(c_name) AS low FROM customer ORDER BY lower(c_name), c_custkey LIMIT 20",
    "so3_nocase_whole": "SELECT c_custkey, lower(c_name) AS low FROM customer ORDER BY lower(c_name), c_custkey",
    "dm1_insert_rows": "SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT k, v FROM (VALUES (100, 'new'), (101, 'newer')) AS t(k, v)",
    "dm8_update_from": "SELECT c_custkey, coalesce(m.n, 0) AS orders_n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) m ON m.o_custkey = c_custkey",
    "dm8_replace": "SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM (SELECT n_regionkey AS k, n_name AS v, n_nationkey AS seq FROM nation) x) t WHERE rn = 1",
    "dm8_returning": "SELECT o_orderkey, o_custkey + 1 AS o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "dm8_delete_limit": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100)",
    "ag5_total": "SELECT n_regionkey, coalesce(sum(cast(n_nationkey AS DOUBLE)), 0.0) AS total, avg(n_nationkey) AS mean FROM nation GROUP BY n_regionkey",
    "fn2_more_strings": "SELECT n_name, ascii(n_name) AS code, chr(65 + n_nationkey) AS ch, ltrim(concat('  ', n_name)) AS lt, rtrim(concat(n_name, '  ')) AS rt, substr(n_name, -3) AS tail, reverse(n_name) AS rev FROM nation",
    "fn3_more_math": "SELECT p_partkey, round(sqrt(p_size), 6) AS s, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS l10, round(sin(p_size), 6) AS si, round(atan2(p_size, 3), 6) AS at, round(degrees(p_size), 6) AS dg FROM part",
    "fn2_hex": "SELECT n_name, hex(n_name) AS hx, n_nationkey + length(hex(n_name)) AS n, repeat('0', 3) AS zeros, left(n_name, 2) AS l, right(n_name, 2) AS r, lpad(n_name, 12, '*') AS lp FROM nation",
    "fn3_hyperbolic": "SELECT n_nationkey, round(sinh(n_nationkey / 10.0), 6) AS sh, round(cosh(n_nationkey / 10.0), 6) AS ch, round(tanh(n_nationkey / 10.0), 6) AS th, round(asinh(n_nationkey / 10.0), 6) AS ash, round(acosh(1 + n_nationkey / 10.0), 6) AS ach, round(exp(n_nationkey / 10.0), 6) AS ex, round(cbrt(n_nationkey), 6) AS cb FROM nation",
    "fn4_shifts": "SELECT p_partkey, p_size << 3 AS l, p_size >> 1 AS r FROM part",
    "dd5_view": "WITH big_orders AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT o_orderstatus, count(*) AS n FROM big_orders GROUP BY o_orderstatus",
}

PAIRS: dict[str, tuple[str, str]] = {
    "pr11_glob_like": ("SELECT n_name FROM nation WHERE n_name RLIKE '^N.*[0-4]$' OR n_name ILIKE '%ia'", "SELECT n_name FROM nation WHERE n_name GLOB 'N*[0-4]' OR n_name ILIKE '%ia'"),
    "ag5_group_concat": (
        "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "ag6_bare_columns": (
        "SELECT user_id, max(event_id) AS last_id, max_by(event_type, event_id) AS last_type FROM events GROUP BY user_id",
        "SELECT user_id, max(event_id) AS last_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id",
    ),
    "wn3_groups": (
        "SELECT n_nationkey, cast(sum(n_nationkey) OVER (ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM (SELECT *, dense_rank() OVER (ORDER BY n_regionkey) AS g FROM nation) t",
        "SELECT n_nationkey, cast(sum(n_nationkey) OVER (ORDER BY n_regionkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM nation",
    ),
    "wn3_exclude": (
        "SELECT event_id, sum(user_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) - user_id AS others FROM events",
        "SELECT event_id, coalesce(cast(sum(user_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT), 0) AS others FROM events",
    ),
    "wn4_filter": (
        "SELECT event_id, count(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS errors FROM events",
        "SELECT event_id, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS errors FROM events",
    ),
    "fn5_json": ("SELECT event_id, cast(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, cast(props->>'$.k' AS BIGINT) AS k FROM events"),
    "fn5_json_keys": ("SELECT event_id, array_join(json_object_keys(props), ',') AS ks FROM events", "SELECT event_id, array_to_string(json_keys(props), ',') AS ks FROM events"),
    "fn5_json_set": (
        "SELECT event_id, to_json(map_concat(map_filter(from_json(props, 'map<string,bigint>'), (k, v) -> k <> 'z'), map('z', event_id))) AS js FROM events",
        "SELECT event_id, cast(json_merge_patch(cast(props AS JSON), cast('{\"z\":' || event_id || '}' AS JSON)) AS VARCHAR) AS js FROM events",
    ),
    "fn6_time": (
        "SELECT event_id, date_format(ts, 'yyyy-MM-dd') AS d, hour(ts) AS h, cast(date_format(date_trunc('month', ts), 'yyyyMMdd') AS INT) AS m FROM events",
        "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, cast(hour(ts) AS INT) AS h, cast(strftime(date_trunc('month', ts), '%Y%m%d') AS INT) AS m FROM events",
    ),
    "fn3_trunc_log2": ("SELECT p_partkey, cast(p_retailprice AS BIGINT) AS t, round(log2(p_size), 6) AS l2, round(log(3, p_size), 6) AS l3 FROM part", "SELECT p_partkey, cast(trunc(p_retailprice) AS BIGINT) AS t, round(log2(p_size), 6) AS l2, round(log(3, p_size), 6) AS l3 FROM part"),
    "fn2_printf": ("SELECT n_name, format_string('%05d|%s|%.2f', n_nationkey, n_name, n_nationkey / 4.0D) AS p FROM nation", "SELECT n_name, printf('%05d|%s|%.2f', n_nationkey, n_name, n_nationkey / 4.0) AS p FROM nation"),
    "fn6_epoch": (
        "SELECT event_id, cast(floor(unix_micros(to_timestamp(ts)) / 1000000) AS BIGINT) AS unix, round(unix_micros(to_timestamp(ts)) / 86400000000.0D + 2440587.5D, 6) AS julian, date_format(date_add(cast(ts AS date), 7), 'yyyy-MM-dd') AS later, date_format(trunc(cast(ts AS date), 'year'), 'yyyy-MM-dd') AS year_start FROM events",
        "SELECT event_id, cast(floor(epoch_us(ts) / 1000000) AS BIGINT) AS unix, round(epoch_us(ts) / 86400000000.0 + 2440587.5, 6) AS julian, strftime(cast(ts AS date) + 7, '%Y-%m-%d') AS later, strftime(date_trunc('year', ts), '%Y-%m-%d') AS year_start FROM events",
    ),
    "fn5_json_remove": (
        "SELECT event_id, to_json(map_filter(map_concat(from_json(props, 'map<string,bigint>'), map('z', event_id)), (k, v) -> k <> 'k')) AS removed, json_array_length('[1,2,3]') AS n, try_parse_json(props) IS NOT NULL AS valid, try_parse_json(replace(props, ':', '')) IS NOT NULL AS broken FROM events",
        "SELECT event_id, '{\"z\":' || event_id || '}' AS removed, cast(json_array_length('[1,2,3]') AS INT) AS n, json_valid(props) AS valid, json_valid(replace(props, ':', '')) AS broken FROM events",
    ),
    "fn5_json_type": ("SELECT event_id, schema_of_variant(variant_get(parse_json(props), '$.k', 'variant')) AS t FROM events", "SELECT event_id, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'BIGINT' ELSE json_type(props, '$.k') END AS t FROM events"),
    "sc13_json_each": (
        "SELECT n_regionkey, j AS v FROM nation LATERAL VIEW explode(from_json(concat('[', n_nationkey, ',', n_regionkey, ']'), 'array<bigint>')) AS j",
        "SELECT n_regionkey, unnest([cast(n_nationkey AS BIGINT), cast(n_regionkey AS BIGINT)]) AS v FROM nation",
    ),
    "ag5_json_array": (
        "SELECT n_regionkey, to_json(array_sort(collect_list(n_nationkey))) AS js FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, '[' || string_agg(cast(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS js FROM nation GROUP BY n_regionkey",
    ),
    "ag5_json_object": (
        "SELECT n_regionkey, to_json(map_from_entries(array_sort(collect_list(struct(n_name, n_nationkey))))) AS js FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS js FROM nation GROUP BY n_regionkey",
    ),
}

Query = Callable[[SparkSession, str], DataFrame]
CODE: dict[str, tuple[Query, str | None]] = {}


def code(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query with its SQL under its function's name."""

    def put(f: Query) -> Query:
        CODE[f.__name__] = (f, oracle)
        return f

    return put


# ---- scans, parameters, results ------------------------------------------------------------


@code("SELECT event_id, event_type FROM events WHERE event_id > 50 AND user_id = 3 AND event_id + 50 > 60")
def pr7_parameters(spark, d):
    return sql(spark, d, "SELECT event_id, event_type FROM events WHERE event_id > :p1 AND user_id = :p2 AND event_id + :p1 > 60", {"p1": 50, "p2": 3})


@code("SELECT n_nationkey AS k, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS js FROM nation")
def sc15_json_rows(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.to_json(F.struct("n_nationkey", "n_name")).alias("js"))


@code("SELECT user_id AS key, min(event_id) AS t, arg_min(event_type, event_id) AS data FROM events GROUP BY user_id")
def sc6_create_if_absent(spark, d):
    return blobs.first_writer(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("t"), F.col("event_type").alias("data")))


@code("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) t WHERE before = 'view'")
def sc7_compare_and_swap(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").withColumn("before", F.lag("event_type").over(w)).filter("before = 'view'").select("event_id")


@code("SELECT n_name AS key, substr(n_name, 3, 4) AS data FROM nation")
def sc8_ranged_read(spark, d):
    df = table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_name").cast("binary").alias("data"))
    return blobs.ranged(df, 2, 4).withColumn("data", F.col("data").cast("string"))


@code("SELECT event_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 10")
def so2_cursor_page(spark, d):
    return polls.page(table(spark, d, "events").select(F.col("event_id").alias("id")), 100, 10).select(F.col("id").alias("event_id"))


@code("SELECT o_orderkey, max(event_id) AS event_id FROM orders JOIN events ON user_id = o_custkey AND event_id <= o_orderkey GROUP BY o_orderkey")
def jn8_as_of(spark, d):
    """The latest event of a customer at or before an order, by one window over both sides' rows."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("t"), F.col("o_orderkey"), F.lit(None).cast("long").alias("event_id"))
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("t"), F.lit(None).cast("long").alias("o_orderkey"), "event_id")
    w = Window.partitionBy("k").orderBy("t", F.col("o_orderkey").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return o.union(e).withColumn("event_id", F.last("event_id", ignorenulls=True).over(w)).filter("o_orderkey is not null and event_id is not null").select("o_orderkey", "event_id")


@code("SELECT user_id, event_id FROM events WHERE concat('u', cast(user_id AS VARCHAR)) = 'u12' OR starts_with(concat('u', cast(user_id AS VARCHAR)), 'u13')")
def jn9_prefix_join(spark, d):
    e = table(spark, d, "events").withColumn("object", F.concat(F.lit("u"), F.col("user_id").cast("string"))).withColumn("verb", F.lit("read"))
    g = sql(spark, d, "SELECT * FROM VALUES ('u12', array('read')), ('u13*', array('read')), ('u9*', array('write')) AS t(pattern, verbs)")
    return grants.allows(e, g).filter("allowed").select("user_id", "event_id")


# ---- logs ----------------------------------------------------------------------------------

_OUT = ", o AS (SELECT event_id AS txn, ok AS committed FROM log WHERE ok OR event_id % 7 <> 0), m AS (SELECT log.*, o.committed FROM log LEFT JOIN o ON o.txn = log.event_id)"
_FOLD = (
    "WITH " + DUCK_LOG + _OUT + ", bad AS (SELECT object, min(seq) AS s FROM m WHERE committed IS DISTINCT FROM true GROUP BY object), ends AS (SELECT log.object, coalesce(min(bad.s) - 1, max(log.seq)) AS seq FROM log LEFT JOIN bad ON bad.object = log.object GROUP BY log.object) "
)


@code(_FOLD + "SELECT object, cast(0 AS BIGINT) AS base_seq, seq FROM ends")
def lg4_committed_seq(spark, d):
    e = event_log(spark, d)
    return log.committed_seq(e, outcomes(e))


@code(
    _FOLD + ", snap AS (SELECT m.object, max(m.seq) AS at FROM m JOIN ends ON ends.object = m.object AND m.seq <= ends.seq WHERE event_type = 'signup' GROUP BY m.object) "
    "SELECT ends.object, cast(0 AS BIGINT) AS base_seq, ends.seq, CASE WHEN snap.at IS NULL THEN NULL ELSE 'signup' END AS payload, ends.seq - coalesce(snap.at, 0) AS deltas_after FROM ends LEFT JOIN snap ON snap.object = ends.object"
)
def lg3_fold_committed(spark, d):
    e = event_log(spark, d)
    return log.fold_committed(e, outcomes(e))


@code("WITH " + DUCK_LOG + " SELECT event_id % 500 AS txn, arg_min(ok, event_id) AS committed FROM log GROUP BY event_id % 500")
def lg2_commit_race(spark, d):
    return log.commit_race(event_log(spark, d).select((F.col("txn") % 500).alias("txn"), F.col("born").alias("t"), F.col("ok").alias("commit")))


@code(
    "WITH " + DUCK_LOG + _OUT + ", a AS (SELECT *, lag(seq, 1, 0) OVER (PARTITION BY object ORDER BY seq) AS expected FROM m), ends AS (SELECT object, coalesce(min(CASE WHEN committed IS DISTINCT FROM true THEN seq END) - 1, max(seq)) AS s FROM m GROUP BY object) "
    "SELECT a.object, -1 AS txn, a.expected, CASE WHEN ends.s <> a.expected THEN 'rebase' WHEN committed THEN 'rival' WHEN committed = false THEN 'retake' WHEN a.event_id + 100 - a.event_id <= 50 THEN 'wait' ELSE 'abort_then_retake' END AS decision FROM a JOIN ends ON ends.object = a.object"
)
def lg5_prewrite(spark, d):
    e = event_log(spark, d)
    m = log.marked(e, outcomes(e))
    attempts = e.select("object", (F.col("seq") - 1).alias("expected"), F.lit(-1).alias("txn"), (F.col("born") + 100).alias("now"))
    return log.prewrite(attempts, m.select("object", "seq", "txn", "born", "committed"), log.committed_seq(e, outcomes(e)), 50).select("object", "txn", "expected", "decision")


@code("WITH " + DUCK_LOG + " SELECT object, seq FROM log WHERE NOT (event_id % 5 = 0 AND NOT ok)")
def lg6_clear_entry(spark, d):
    e = event_log(spark, d)
    return log.clear_entries(e, outcomes(e), e.filter("txn % 5 = 0")).select("object", "seq")


@code(_FOLD + "SELECT object, seq AS base_seq FROM ends WHERE seq >= 8")
def lg7_compaction(spark, d):
    e = event_log(spark, d)
    return log.compaction_due(log.committed_seq(e, outcomes(e)))


@code("SELECT p_partkey, CASE WHEN p_size * 4000 < 65536 THEN 'snapshot' WHEN (p_partkey % 20) + 1 > 16 OR p_size * 500 * 3 > p_size * 4000 THEN 'compacting' ELSE 'delta' END AS choice FROM part")
def lg9_ship_choice(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 4000).alias("size"), (F.col("p_partkey") % 20).alias("chain"), (F.col("p_size") * 500).alias("delta"))
    return p.select("p_partkey", log.ship_choice().alias("choice"))


@code("SELECT n_name AS object, n_name || repeat('x', 10) || upper(n_name) || 'new' AS image FROM nation")
def lg8_page_diff_apply(spark, d):
    """Old and new images cut in 8-byte pages, differing pages shipped and applied again."""
    n = table(spark, d, "nation")
    old = n.select(F.col("n_name").alias("object"), F.lit(1).alias("version"), F.concat("n_name", F.lit("x" * 10), F.lower("n_name")).cast("binary").alias("image"))
    new = n.select(F.col("n_name").alias("object"), F.lit(2).alias("version"), F.concat("n_name", F.lit("x" * 10), F.upper("n_name"), F.lit("new")).cast("binary").alias("image"))
    a, b = log.pages(old, 8), log.pages(new, 8)
    out = log.page_apply(a, log.page_diff(a, b), new.select("object", F.length("image").alias("length")), 8)
    return out.select("object", F.col("image").cast("string").alias("image"))


# ---- transactions --------------------------------------------------------------------------


@code("SELECT l_orderkey AS txn, CASE WHEN count(DISTINCT l_partkey) > 0 AND bool_or(l_linenumber = 7) THEN 'undeclared object' END AS error, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey")
def tx1_validate(spark, d):
    li = table(spark, d, "lineitem")
    obj = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    op = F.when(F.col("l_linenumber") == 7, F.lit("stray")).otherwise(obj)
    t = li.groupBy(F.col("l_orderkey").alias("txn")).agg(F.collect_list(obj).alias("objects"), F.collect_list(F.struct(op.alias("object"))).alias("ops"))
    return txn.validate(t).select("txn", "error", F.size("participants").cast("long").alias("n"))


@code(
    "WITH RECURSIVE g AS (SELECT DISTINCT l_orderkey AS t, l_partkey AS p FROM lineitem WHERE l_quantity = 1), e AS (SELECT DISTINCT a.t AS x, b.t AS y FROM g a JOIN g b ON a.p = b.p), "
    "r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y) SELECT x AS txn, min(y) AS component FROM r GROUP BY x"
)
def tx6_components(spark, d):
    return txn.transaction_components(tx_graph(spark, d))


@code(
    "WITH RECURSIVE g AS (SELECT DISTINCT l_orderkey AS t, l_partkey AS p FROM lineitem WHERE l_quantity = 1), e AS (SELECT DISTINCT a.t AS x, b.t AS y FROM g a JOIN g b ON a.p = b.p), "
    "r(y) AS (SELECT t FROM g WHERE p % 10 = 3 UNION SELECT e.y FROM r JOIN e ON e.x = r.y) SELECT DISTINCT y AS txn FROM r"
)
def tx8_revert_closure(spark, d):
    g = tx_graph(spark, d)
    return txn.revert_closure(g, g.filter("object like '%3'").select("object"))


@code(
    "WITH RECURSIVE i AS (SELECT user_id % 16 AS worker, event_id AS pos, cast(round(value * 100) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS rn FROM events), "
    "r(worker, rn, pos, bytes, used, aboard) AS (SELECT worker, rn, pos, bytes, bytes, true FROM i WHERE rn = 1 UNION ALL SELECT i.worker, i.rn, i.pos, i.bytes, CASE WHEN r.used + i.bytes <= 100000 THEN r.used + i.bytes ELSE r.used END, r.used + i.bytes <= 100000 FROM r JOIN i ON i.worker = r.worker AND i.rn = r.rn + 1) "
    "SELECT worker, pos, bytes, aboard FROM r"
)
def tx7_boat_cut(spark, d):
    items = table(spark, d, "events").select((F.col("user_id") % 16).alias("worker"), F.col("event_id").alias("pos"), F.round(F.col("value") * 100).cast("long").alias("bytes"))
    return txn.boat_cut(items, 100_000)


@code(
    "WITH RECURSIVE t AS (SELECT o_orderkey AS txn, o_custkey - o_custkey % 8 AS g, o_custkey % 8 AS i, (o_custkey + 1 + o_orderkey % 7) % 8 AS j, o_orderkey % 60 AS amt, row_number() OVER (PARTITION BY o_custkey - o_custkey % 8 ORDER BY o_orderkey) AS rn FROM orders), "
    "r(g, rn, txn, accepted, st) AS (SELECT g, cast(0 AS BIGINT), cast(NULL AS BIGINT), cast(NULL AS BOOLEAN), cast([100, 100, 100, 100, 100, 100, 100, 100] AS BIGINT[]) FROM (SELECT DISTINCT g FROM t) x UNION ALL "
    "SELECT t.g, t.rn, t.txn, st[i + 1] >= amt, CASE WHEN st[i + 1] >= amt THEN list_transform(st, lambda x, k: CASE WHEN k = i + 1 THEN x - amt WHEN k = j + 1 THEN x + amt ELSE x END) ELSE st END FROM r JOIN t ON t.g = r.g AND t.rn = r.rn + 1) "
    "SELECT txn, accepted FROM r WHERE rn > 0"
)
def tx2_replay_transfers(spark, d):
    o = tx_transfers(spark, d)
    return txn.replay_transfers(o, 100)


def tx_transfers(spark, d):
    """Transfers between accounts in groups of eight, so components stay small."""
    o = table(spark, d, "orders")
    group = F.col("o_custkey") - F.col("o_custkey") % 8
    return o.select(F.col("o_orderkey").alias("txn"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("src"), (group + (F.col("o_custkey") + 1 + F.col("o_orderkey") % 7) % 8).alias("dst"), (F.col("o_orderkey") % 60).alias("amt"))


@code("WITH " + DUCK_LOG + " SELECT object, seq, CASE WHEN event_type IN ('view','click') AND sum(abs(amt)) OVER w <= 20000 THEN 'at once' ELSE 'with the boat' END AS ack, count(*) FILTER (WHERE event_type NOT IN ('view','click')) OVER w AS barrier FROM log WINDOW w AS (PARTITION BY object ORDER BY seq)")
def tx4_acks(spark, d):
    e = event_log(spark, d).select(F.col("object").alias("worker"), "seq", F.abs("amt").alias("bytes"), F.col("payload").isin("view", "click").alias("optimistic"))
    return txn.acks(e, 20_000).select(F.col("worker").alias("object"), "seq", "ack", "barrier")


@code("SELECT l_partkey AS object, l_orderkey AS txn, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS position FROM lineitem")
def tx5_admission(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("object"), F.col("l_orderkey").alias("txn"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("arrival"))
    return txn.admission(li, F.floor(F.col("txn") / 4096)).select("object", "txn", F.col("position").cast("long").alias("position"))


@code("SELECT o_custkey AS object FROM orders GROUP BY o_custkey HAVING max(o_orderkey) > 1000")
def tx3_changed_set(spark, d):
    o = table(spark, d, "orders")
    h = F.max("o_orderkey").alias("hash")
    after = o.groupBy(F.col("o_custkey").alias("object")).agg(h)
    before = o.filter("o_orderkey <= 1000").groupBy(F.col("o_custkey").alias("object")).agg(h)
    return txn.changed(before, after)


@code("SELECT user_id AS object, event_type AS k FROM events EXCEPT SELECT user_id, event_type FROM events WHERE event_id % 5 = 0")
def tx9_content_fence(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("object"), F.col("event_type").alias("k"), "event_id")
    return txn.content_fence(e, e.filter("event_id % 5 = 0"))


# ---- live queries, wills, grants -----------------------------------------------------------


@code("SELECT user_id AS object, event_id AS version FROM (SELECT *, lag(event_type) OVER w AS was, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) t WHERE event_type IS DISTINCT FROM was OR rn = 1")
def pl2_change_detection(spark, d):
    v = table(spark, d, "events").select(F.col("user_id").alias("object"), F.col("event_id").alias("version"), F.xxhash64("event_type").alias("hash"))
    return polls.change_fires(v).select("object", "version")


@code("SELECT user_id AS object, count(*) AS rows FROM events WHERE event_type = 'error' GROUP BY user_id")
def pl1_condition(spark, d):
    v = table(spark, d, "events").groupBy(F.col("user_id").alias("object")).agg(F.count_if(F.col("event_type") == "error").alias("rows"))
    return polls.condition_fires(v)


@code("SELECT user_id AS feed, cast(floor((rn - 1) / 8.0) AS BIGINT) AS page, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS rows FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) t GROUP BY user_id, floor((rn - 1) / 8.0)")
def pl7_cursor_pages(spark, d):
    return polls.pages(table(spark, d, "events").select(F.col("user_id").alias("feed"), F.col("event_id").alias("id")), 8)


def _wills(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_name").alias("session"), (F.col("c_custkey") % 100).alias("deadline"), (F.col("c_custkey") % 30).alias("claim_deadline"), F.when(F.col("c_custkey") % 11 == 0, "garbage").otherwise('{"ops":[]}').alias("payload"))


@code("SELECT c_name AS session FROM customer WHERE c_custkey % 100 < 50 AND c_custkey % 30 < 50 AND c_custkey % 11 <> 0")
def wl3_sweep(spark, d):
    return wills.fire(_wills(spark, d), 50)[0].select("session")


@code("SELECT c_name AS session, CASE WHEN c_nationkey = 3 THEN 500 ELSE c_custkey % 100 END AS deadline FROM customer")
def wl2_refresh(spark, d):
    live = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_name").alias("session"))
    return wills.refresh(_wills(spark, d), live, 500).select("session", F.col("deadline").cast("long").alias("deadline"))


@code("SELECT c_name AS session, CASE WHEN c_custkey % 2 = 0 THEN 900 ELSE c_custkey % 100 END AS deadline FROM customer WHERE c_custkey % 6 <> 0")
def wl1_arm(spark, d):
    c = table(spark, d, "customer").filter("c_custkey % 2 = 0")
    armed = c.select(F.col("c_name").alias("session"), F.lit(1).alias("at"), F.lit(900).cast("long").alias("deadline"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("{}").alias("payload"))
    return wills.arm(_wills(spark, d), armed).select("session", F.col("deadline").cast("long").alias("deadline"))


@code("SELECT n_name AS object, CASE WHEN n_name = 'NATION_3' OR (starts_with(n_name, 'NATION_1')) THEN true ELSE false END AS allowed FROM nation")
def gr2_allows(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("object"), F.lit("insert").alias("verb"))
    g = sql(spark, d, "SELECT * FROM VALUES ('NATION_3', array('insert')), ('NATION_1*', array('write')), ('NATION_2*', array('read', 'poll')), ('N*X', array('write')) AS t(pattern, verbs)")
    return grants.allows(n, g).select("object", "allowed")


@code(
    "SELECT a AS action, CASE WHEN a IN ('select','function','transaction','savepoint','recursive') THEN true WHEN a IN ('pragma','attach','detach') THEN false WHEN a IN ('insert','read') THEN true ELSE false END AS allowed FROM (VALUES ('select'),('function'),('transaction'),('savepoint'),('recursive'),('pragma'),('attach'),('detach'),('insert'),('update'),('delete'),('read'),('create_table')) t(a)"
)
def gr4_action_gate(spark, d):
    actions = spark.createDataFrame([(a,) for a in ("select", "function", "transaction", "savepoint", "recursive", "pragma", "attach", "detach", "insert", "update", "delete", "read", "create_table")], "action string")
    return actions.withColumn("allowed", grants.gate(F.col("action"), F.array(F.lit("insert"))))


# ---- placement -----------------------------------------------------------------------------

_FNV = "list_reduce([cast(14695981039346656037 AS HUGEINT)] || list_transform(range(1, length({o}) + 1), lambda i: cast(ascii(substr({o}, i, 1)) AS HUGEINT)), lambda h, b: ((h - h % 256 + xor(cast(h % 256 AS INT), cast(b AS INT))) * 1099511628211) % 18446744073709551616)"


@code("SELECT n_name AS object, cast(" + _FNV.format(o="n_name") + " % 4096 AS BIGINT) AS worker FROM nation")
def rt1_default_worker(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("object"), scalar.default_worker(F.col("n_name"), 4096).alias("worker"))


@code("SELECT n_name AS object, CASE WHEN n_nationkey < 5 THEN 77 ELSE cast(" + _FNV.format(o="n_name") + " % 4096 AS BIGINT) END AS worker FROM nation")
def rt1_owner(spark, d):
    n = table(spark, d, "nation")
    return placement.owner(n.select(F.col("n_name").alias("object")), n.filter("n_nationkey < 5").select(F.col("n_name").alias("object"), F.lit(77).cast("long").alias("worker")), 4096)


@code(
    "WITH v AS (SELECT l_orderkey AS txn, l_suppkey % 16 AS worker, count(*) AS n FROM lineitem GROUP BY 1, 2), ld AS (SELECT s_suppkey % 16 AS worker, count(*) AS e FROM supplier GROUP BY 1) "
    "SELECT txn, worker FROM (SELECT v.txn, v.worker, row_number() OVER (PARTITION BY txn ORDER BY n DESC, coalesce(e, 0), v.worker) AS rn FROM v LEFT JOIN ld ON ld.worker = v.worker) t WHERE rn = 1"
)
def rt2_plurality(spark, d):
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("txn"), F.col("l_partkey").alias("object"), (F.col("l_suppkey") % 16).alias("worker"))
    load = table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 16).alias("worker")).agg(F.count("*").alias("exceptions"))
    return placement.plurality_target(parts, load)


@code("WITH p AS (SELECT c_nationkey AS worker, count(*) AS exceptions FROM customer WHERE c_acctbal > 5000 GROUP BY 1) SELECT worker, exceptions, exceptions >= greatest(4, cast(floor(2 * (SELECT sum(exceptions) FROM p) / 25.0) AS BIGINT)) AS crowded FROM p")
def rt3_crowded(spark, d):
    return placement.crowded(table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("worker")), 25)


@code(
    "WITH t AS (SELECT user_id AS object, event_id AS tick, event_id % 3 AS worker FROM events), f AS (SELECT *, CASE WHEN lag(worker) OVER w = worker AND tick - lag(tick) OVER w <= 1000 THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY object ORDER BY tick)), "
    "i AS (SELECT *, sum(fresh) OVER (PARTITION BY object ORDER BY tick) AS island FROM f), v AS (SELECT object, tick, row_number() OVER (PARTITION BY object, island ORDER BY tick) AS visits FROM i) SELECT object, tick, visits, visits >= 3 AS rehome FROM v"
)
def rt4_visits(spark, d):
    deeds = table(spark, d, "events").select(F.col("user_id").alias("object"), F.col("event_id").alias("tick"), (F.col("event_id") % 3).alias("worker"))
    return placement.visits(deeds).select("object", "tick", F.col("visits").cast("long").alias("visits"), "rehome")


@code("SELECT o_orderkey, greatest(o_custkey % 9, o_orderkey % 5, 0) + 1 AS next_generation, (o_orderstatus = 'P' OR o_orderkey - o_custkey >= 200) AS settled FROM orders")
def rt5_release(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 9).alias("generation"), (F.col("o_orderkey") % 5).alias("transit_generation"), F.col("o_custkey").alias("arrived_at"), (F.col("o_orderstatus") == "P").alias("travelling"))
    return placement.release(o).select("o_orderkey", F.col("next_generation").cast("long").alias("next_generation"), "settled")


@code("SELECT object, worker, generation, owned FROM (SELECT l_partkey AS object, l_suppkey AS worker, l_orderkey % 50 AS generation, l_linenumber % 2 = 0 AS owned, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey % 50 DESC, l_linenumber % 2 = 0 DESC, l_suppkey) AS rn FROM lineitem) t WHERE rn = 1")
def rt7_best_claim(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_partkey").alias("object"), F.col("l_suppkey").alias("worker"), (F.col("l_orderkey") % 50).alias("generation"), (F.col("l_linenumber") % 2 == 0).alias("owned"))
    return placement.best_claim(c)


@code("SELECT user_id % 64 AS block, max(event_id) AS epoch, arg_max(user_id, event_id) AS holder, bool_or(event_type = 'error' AND event_id = m) AS released FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id % 64) AS m FROM events) t GROUP BY user_id % 64")
def rt9_leases(spark, d):
    e = table(spark, d, "events")
    leases = e.select((F.col("user_id") % 64).alias("block"), F.col("event_id").alias("epoch"), F.col("user_id").alias("holder"))
    return placement.lease_holders(leases, e.filter("event_type = 'error'").select((F.col("user_id") % 64).alias("block"), F.col("event_id").alias("epoch")))


@code("SELECT b AS block FROM (SELECT user_id % 64 AS b, max(event_id) AS m, min(event_id) AS mine FROM events GROUP BY 1) t WHERE m > mine")
def rt10_superseded(spark, d):
    leases = table(spark, d, "events").select((F.col("user_id") % 64).alias("block"), F.col("event_id").alias("epoch"))
    return placement.superseded(leases.groupBy("block").agg(F.min("epoch").alias("epoch")), leases)


@code("SELECT cast(n_nationkey AS BIGINT) AS object, cast(n_nationkey % 4 + least(8, n_regionkey * 3) AS BIGINT) AS worker, cast(least(8, n_regionkey * 3) AS INT) AS hops FROM nation")
def rt11_take_chase(spark, d):
    """Each nation's hints lead from worker to worker, three for each region number; eight are followed at most."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("object"), (F.col("n_nationkey") % 4).cast("long").alias("worker"), (F.col("n_regionkey") * 3).alias("steps"))
    hints = n.filter("steps > 0").select("object", "worker", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("s")).select("object", (F.col("worker") + F.col("s")).alias("worker"), (F.col("worker") + F.col("s") + 1).alias("next"))
    return placement.chase(hints, n)


@code("SELECT p_partkey AS worker, cast(floor(p_partkey * 256 / 4096.0) AS BIGINT) AS block, cast(ceil(floor(p_partkey * 256 / 4096.0) * 4096 / 256.0) AS BIGINT) AS lo FROM part")
def rt12_blocks(spark, d):
    b = placement.block_of(F.col("p_partkey"), 256, 4096)
    return table(spark, d, "part").select(F.col("p_partkey").alias("worker"), b.alias("block"), placement.block_range(b, 256, 4096)[0].alias("lo"))


@code(
    "SELECT l_orderkey % 8 AS worker, file, e AS evicted FROM (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS file, c AND u - coalesce(sum(b) OVER (PARTITION BY l_orderkey % 8, c ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 5000 AS e "
    "FROM (SELECT *, l_returnflag <> 'R' AS c, cast(l_quantity AS BIGINT) AS b, sum(cast(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey % 8) AS u FROM lineitem) x) t"
)
def rs2_disk_ledger(spark, d):
    key = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("f"), "l_partkey", "l_suppkey", "l_extendedprice")
    files = table(spark, d, "lineitem").select((F.col("l_orderkey") % 8).alias("worker"), key.alias("file"), F.col("l_quantity").cast("long").alias("bytes"), F.col("l_shipdate").alias("touched"), (F.col("l_returnflag") != "R").alias("cache"))
    return placement.evict(files, 5000).select("worker", F.col("file")["f"].alias("file"), "evicted")


@code("SELECT user_id % 16 AS worker, count(*) AS txns, count(*) FILTER (WHERE event_type = 'error') AS failed, count(DISTINCT user_id) AS objects, cast(sum(cast(round(value * 100) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY user_id % 16")
def st1s_stats(spark, d):
    e = table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 16).alias("worker")).agg(F.count("*").alias("txns"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_distinct("user_id").alias("objects"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("bytes"))


# ---- audits --------------------------------------------------------------------------------


@code("WITH legs AS (SELECT o_orderkey AS k, -(o_orderkey % 60) AS amt FROM orders UNION ALL SELECT o_orderkey, o_orderkey % 60 FROM orders WHERE o_orderkey % 13 <> 0) SELECT k, count(*) AS legs, cast(sum(amt) AS BIGINT) AS net, count(*) FILTER (WHERE amt < 0) AS debits FROM legs GROUP BY k HAVING count(*) <> 2 OR sum(amt) <> 0 OR count(*) FILTER (WHERE amt < 0) <> 1")
def df18_torn_transfers(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 60).alias("amt"))
    return audits.torn_transfers(o.select("k", (-F.col("amt")).alias("amt")).union(o.filter("k % 13 <> 0")))


@code("SELECT count(*) AS accounts, cast(sum(cast(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS total, count(*) * 100 AS expected, sum(cast(round(c_acctbal * 100) AS BIGINT)) = count(*) * 100 AS ok FROM customer")
def df18_conserved(spark, d):
    return audits.conserved(table(spark, d, "customer").select(F.round(F.col("c_acctbal") * 100).cast("long").alias("balance")), 100)


@code("SELECT cast((SELECT sum(cast(round(c_acctbal * 100) AS BIGINT)) FROM customer) AS BIGINT) AS held, cast((SELECT sum(cast(round(s_acctbal * 100) AS BIGINT)) FROM supplier) AS BIGINT) AS issued, false AS ok")
def df19_supply(spark, d):
    return audits.supply(table(spark, d, "customer").select(F.round(F.col("c_acctbal") * 100).cast("long").alias("balance")), table(spark, d, "supplier").select(F.round(F.col("s_acctbal") * 100).cast("long").alias("amt")))


@code(
    "WITH op AS (SELECT o_orderkey AS saga, o_custkey AS payee, o_custkey + 1 AS funder, o_orderkey % 4 AS amt FROM orders WHERE o_orderkey % 17 <> 0), st AS (SELECT l_orderkey AS saga, CASE WHEN l_returnflag = 'R' THEN 'refund' ELSE 'release' END AS dir FROM lineitem WHERE l_linenumber = 1), "
    "cr AS (SELECT o_orderkey AS saga, o_custkey AS party, o_orderkey % 4 AS amt FROM orders) "
    "SELECT saga, 'settled twice' AS fault FROM st GROUP BY saga HAVING count(*) > 1 UNION ALL SELECT DISTINCT saga, 'never opened' FROM st WHERE saga NOT IN (SELECT saga FROM op) "
    "UNION ALL SELECT DISTINCT st.saga, 'not credited' FROM st JOIN op ON op.saga = st.saga WHERE NOT EXISTS (SELECT 1 FROM cr WHERE cr.saga = st.saga AND cr.amt = op.amt AND cr.party = CASE WHEN st.dir = 'release' THEN op.payee ELSE op.funder END)"
)
def df20_escrow(spark, d):
    o = table(spark, d, "orders")
    amt = (F.col("o_orderkey") % 4).alias("amt")
    opened = o.filter("o_orderkey % 17 <> 0").select(F.col("o_orderkey").alias("saga"), F.col("o_custkey").alias("payee"), (F.col("o_custkey") + 1).alias("funder"), amt)
    st = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("saga"), F.when(F.col("l_returnflag") == "R", "refund").otherwise("release").alias("dir"))
    return audits.escrow_faults(opened, st, o.select(F.col("o_orderkey").alias("saga"), F.col("o_custkey").alias("party"), amt))


@code("WITH n AS (SELECT c_custkey AS object, 10 AS n FROM customer), r AS (SELECT o_custkey AS object, count(DISTINCT o_orderkey) AS real FROM orders GROUP BY 1) SELECT coalesce(n.object, r.object) AS object, n, real FROM n FULL JOIN r ON n.object = r.object WHERE coalesce(n, 0) <> coalesce(real, 0)")
def df21_counters(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("object"), F.lit(10).alias("n"))
    return audits.counter_faults(c, table(spark, d, "orders").select(F.col("o_custkey").alias("object"), F.col("o_orderkey").alias("k")))


@code(
    "WITH f AS (SELECT event_id AS id, event_id AS k FROM events WHERE event_id % 10 <> 9), dl AS (SELECT concat('c', cast(user_id % 3 AS VARCHAR)) AS consumer, event_id AS pos, CASE WHEN event_id % 97 = 0 THEN event_id - 50 ELSE event_id END AS id, event_id AS k, user_id % 2 = 0 AS durable FROM events WHERE event_id % 20 <> 1) "
    "SELECT 'missed' AS fault, NULL AS consumer, id FROM f WHERE k NOT IN (SELECT k FROM dl) UNION ALL SELECT 'phantom', consumer, id FROM dl WHERE durable AND NOT EXISTS (SELECT 1 FROM f WHERE f.id = dl.id AND f.k = dl.k) "
    "UNION ALL SELECT 'order', consumer, id FROM (SELECT *, lag(id) OVER (PARTITION BY consumer ORDER BY pos) AS was FROM dl) t WHERE was >= id"
)
def df22_feed(spark, d):
    e = table(spark, d, "events")
    final = e.filter("event_id % 10 <> 9").select(F.col("event_id").alias("id"), F.col("event_id").alias("k"))
    dl = e.filter("event_id % 20 <> 1").select(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("consumer"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 97 == 0, F.col("event_id") - 50).otherwise(F.col("event_id")).alias("id"), F.col("event_id").alias("k"), (F.col("user_id") % 2 == 0).alias("durable"))
    return audits.feed_faults(final, dl)


@code("SELECT c_custkey AS k, 'never ran' AS fault FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_custkey % 3 <> 0 UNION ALL SELECT DISTINCT o_custkey, 'not armed' FROM orders WHERE o_totalprice > 300000 AND o_custkey % 3 = 0")
def df24_wills_audit(spark, d):
    return audits.will_faults(table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k")))


@code("SELECT event_id AS k FROM events WHERE event_type <> 'error' AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 50 <> 3)")
def df25_subscribers(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("k"), "event_type")
    return audits.lost(e.filter("event_type <> 'error'"), e.filter("k % 50 <> 3"))


@code(
    "SELECT 'not_null(o_custkey)' AS constraint, count(*) FILTER (WHERE o_custkey IS NULL) AS rows FROM orders UNION ALL SELECT 'check(price)', count(*) FILTER (WHERE NOT o_totalprice >= 1000) FROM orders UNION ALL SELECT 'unique(o_orderkey)', 0 UNION ALL SELECT 'references(o_custkey)', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)"
)
def df17_constraints(spark, d):
    parent = table(spark, d, "customer").filter("c_custkey % 5 <> 0").select("c_custkey")
    return audits.constraint_faults(table(spark, d, "orders"), "o_orderkey", ["o_custkey"], {"price": "o_totalprice >= 1000"}, parent, "o_custkey")


@code("WITH " + DUCK_LOG + " SELECT object, cast(sum(amt) FILTER (WHERE ok) AS BIGINT) AS balance, cast(coalesce(sum(amt) FILTER (WHERE NOT ok), 0) AS BIGINT) AS rolled_back FROM log GROUP BY object")
def dm5_commutative_replay(spark, d):
    """Unguarded updates commute, so their replay is a sum."""
    return event_log(spark, d).groupBy("object").agg(F.sum(F.when(F.col("ok"), F.col("amt"))).alias("balance"), F.coalesce(F.sum(F.when(~F.col("ok"), F.col("amt"))), F.lit(0)).alias("rolled_back"))


@code("SELECT p_partkey, cast(p_size // 7 AS BIGINT) AS q, p_size % 7 AS r, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_partkey // (p_size % 7) END AS by_zero, least(p_size, p_partkey) AS lo FROM part")
def fn7_integer_semantics(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", scalar.int_div(s, F.lit(7)).alias("q"), scalar.int_mod(s, F.lit(7)).alias("r"), scalar.int_div(k, s % 7).alias("by_zero"), scalar.least_of(s, k).alias("lo"))


@code("SELECT event_id, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH + to_days(cast(day(ts) - 1 AS INT)), '%Y-%m-%d') AS d FROM events")
def fn6_month_overflow(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", scalar.add_months_overflowing(F.col("ts"), 1).cast("string").alias("d"))


@code("SELECT n_nationkey, '''' || replace(n_name, '_', '''''') || '''' AS q, CASE WHEN n_nationkey > 3 THEN 'integer' ELSE 'null' END AS t, n_nationkey % 10 AS i FROM nation")
def fn2_quote_typeof(spark, d):
    n = table(spark, d, "nation")
    text = F.replace("n_name", F.lit("_"), F.lit("'"))
    lead = F.concat((F.col("n_nationkey") % 10).cast("string"), F.lit("abc"))
    return n.select("n_nationkey", scalar.quote(text, "string").alias("q"), scalar.typeof(F.when(F.col("n_nationkey") > 3, F.col("n_nationkey")), "int").alias("t"), scalar.to_integer(lead).cast("int").alias("i"))


@code("SELECT user_id, count(*) AS n, cast(floor(epoch(min(ts))) AS BIGINT) AS first_s FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, s")
def st_sessions(spark, d):
    """Sessions of a user with gaps under an hour, as the streaming operator makes them."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.unix_timestamp(F.min("ts")).alias("first_s")).select("user_id", "n", "first_s")


# ---- codecs, recovery, node limits -----------------------------------------------------------


@code("SELECT event_id, format('{:02x}{:016x}{:04x}', CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END, event_id, length('t' || event_id)) || lower(hex('t' || event_id)) || lower(hex(event_type)) AS entry, event_type AS back FROM events")
def lg1_entry_codec(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "snapshot").otherwise("delta")
    b = log.encode_entry(kind, F.col("event_id"), F.concat(F.lit("t"), F.col("event_id").cast("string")), F.col("event_type").cast("binary"))
    e = e.select("event_id", b.alias("b"))
    return e.select("event_id", F.lower(F.hex("b")).alias("entry"), log.decode_entry(F.col("b"))["payload"].cast("string").alias("back"))


@code("SELECT user_id AS object, max(CASE WHEN event_id % 4 = 0 OR event_type <> 'error' THEN event_id END) AS counter FROM events GROUP BY user_id HAVING counter IS NOT NULL")
def lg10_recovery(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("txn"), F.col("user_id").alias("object"), F.col("event_id").alias("counter"), "event_type")
    return log.roll_forward(e.filter("counter % 4 = 0"), e.filter("event_type <> 'error'"), e)[0]


@code("WITH " + DUCK_LOG + ", b AS (SELECT object, min(seq) AS s FROM log WHERE NOT ok GROUP BY object) SELECT log.object, count(*) AS n FROM log LEFT JOIN b ON b.object = log.object WHERE b.s IS NULL OR seq < b.s GROUP BY log.object")
def sc4_durable_read(spark, d):
    e = event_log(spark, d)
    return log.durable_view(e, e.select("txn", F.col("ok").alias("committed"))).groupBy("object").agg(F.count("*").alias("n"))


@code("WITH " + DUCK_LOG + " SELECT object, count(*) AS n FROM log WHERE ok OR event_id % 7 = 0 GROUP BY object")
def sc2_live_read(spark, d):
    e = event_log(spark, d)
    return log.live_view(e, outcomes(e)).groupBy("object").agg(F.count("*").alias("n"))


@code("SELECT c_custkey AS object, c_custkey % 16 AS worker, c_nationkey AS home FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING' AND c_nationkey <> c_custkey % 16")
def rt6_going_home(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("object"), (F.col("c_custkey") % 16).alias("worker"), F.col("c_nationkey").alias("home"), (F.col("c_acctbal") > 0).alias("idle"), (F.col("c_mktsegment") == "BUILDING").alias("dirty"))
    return placement.going_home(c)


@code("SELECT p_brand AS object, worker, worker <> cast(" + _FNV.format(o="p_brand") + " % 64 AS BIGINT) AS exception FROM (SELECT p_brand, p_partkey % 64 AS worker, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey % 64) AS rn FROM part) t WHERE rn = 1")
def rt8_reconcile(spark, d):
    c = table(spark, d, "part").select(F.col("p_brand").alias("object"), (F.col("p_partkey") % 64).alias("worker"), F.col("p_size").alias("generation"))
    return placement.reconcile(c, 64)


@code("SELECT p_partkey, cast(floor(m * 6 / 10.0) AS BIGINT) AS disk_budget, least(greatest(m // 8, 16777216), 1073741824) AS boat, CASE WHEN m >= 4294967296 THEN 4 ELSE 2 END AS permits FROM (SELECT p_partkey, cast(p_size AS BIGINT) * 268435456 AS m FROM part) t")
def rs1_limits(spark, d):
    m = F.col("p_size").cast("long") * (256 << 20)
    return table(spark, d, "part").select("p_partkey", placement.limits(m, m).alias("l")).select("p_partkey", "l.*")


@code("SELECT o_orderkey AS object FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' AND o_custkey % 3 = 0)")
def rs3_shed(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("object"), (F.col("o_orderstatus") == "F").alias("idle"), (F.col("o_orderpriority") == "1-URGENT").alias("dirty"), (F.col("o_custkey") % 3).alias("queued"))
    return placement.shed(o).select("object")


@code("SELECT user_id, cast(" + _FNV.format(o="t") + " AS VARCHAR) AS hash FROM (SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS t FROM events WHERE event_id < 400 GROUP BY user_id) x")
def df23_trace_hash(spark, d):
    """``trace_hash`` of the log's first 400 events, as far as the SQL goes."""
    return trace_hash(table(spark, d, "events").filter("event_id < 400"))


@code("SELECT user_id, cast(" + _FNV.format(o="t") + " AS VARCHAR) AS hash FROM (SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS t FROM events GROUP BY user_id) x")
def df23_trace_hash_whole(spark, d):
    """``trace_hash`` of all events."""
    return trace_hash(table(spark, d, "events"))


@code("SELECT n_name, format('{:016x}', cast(" + _FNV.format(o="r") + " AS UHUGEINT)) AS hash FROM (SELECT n_name, '[{\"rows\":[{\"n\":' || n_nationkey || '}]}]' AS r FROM nation) t")
def pl3_poll_hash(spark, d):
    r = F.concat(F.lit('[{"rows":[{"n":'), F.col("n_nationkey").cast("string"), F.lit("}]}]"))
    h = scalar.fnv1a64(r)
    # a decimal of 64 unsigned bits, as two halves of 32
    half = F.lit(1 << 32).cast("decimal(20,0)")
    hx = F.concat(*[F.lpad(F.lower(F.hex(x.cast("long"))), 8, "0") for x in (F.floor(h / half), h % half)])
    return table(spark, d, "nation").select("n_name", hx.alias("hash"))


@code("SELECT asked, held, asked = held OR (held = 'write' AND asked IN ('insert','update','delete','ddl')) OR (asked = 'write' AND held IN ('insert','update','delete','ddl','write')) AS covered FROM (VALUES ('read'),('poll'),('insert'),('update'),('delete'),('ddl'),('write')) a(asked), (VALUES ('read'),('poll'),('insert'),('update'),('delete'),('ddl'),('write')) b(held)")
def gr3_verb_covered(spark, d):
    v = spark.createDataFrame([(a, b) for a in grants.VERBS for b in grants.VERBS], "asked string, held string")
    return v.withColumn("covered", grants.verb_covered(F.col("asked"), F.array("held")))


@code("SELECT event_type, count(*) AS n, cast(floor(epoch(time_bucket(INTERVAL 1 HOUR, ts))) AS BIGINT) AS start_s FROM events GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, ts)")
def st_tumbling(spark, d):
    """The streaming window count, run over a batch."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.tumbling(e, "ts", "1 hour", "10 minutes", "event_type").select("event_type", "n", F.unix_timestamp("start").alias("start_s"))


def _stream(spark, d):
    """The events table as a stream of files."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(df, mode: str):
    """What a stream of all files at hand has written in the end."""
    spark, out = df.sparkSession, scratch(df.sparkSession, "stream")

    def put(batch, epoch):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", scratch(spark, "stream-offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@code("SELECT event_type, count(*) AS n, cast(floor(epoch(time_bucket(INTERVAL 1 HOUR, ts))) AS BIGINT) AS start_s FROM events GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, ts)")
def st_stream_tumbling(spark, d):
    return _drained(live.tumbling(_stream(spark, d), "ts", "1 hour", "10 minutes", "event_type"), "complete").select("event_type", "n", F.unix_timestamp("start").alias("start_s"))


@code("SELECT DISTINCT user_id FROM events")
def st_stream_dedup(spark, d):
    return _drained(live.exactly_once(_stream(spark, d).select("user_id", "ts"), "user_id", "ts", "3650 days"), "append").select("user_id")


# ---- polls, ships, closes, routes, tokens, generator -----------------------------------------


@code(
    "WITH c AS (SELECT user_id AS object, event_id AS seq, event_type <> 'click' AS durable, CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END AS rows FROM events), "
    "p AS (SELECT o_orderkey AS poll, o_custkey AS object, o_orderkey % 10000 AS since, o_orderkey % 2 = 0 AS durable FROM orders), "
    "n AS (SELECT p.*, (SELECT arg_max(rows, seq) FROM c WHERE c.object = p.object AND c.seq <= p.since AND (c.durable OR NOT p.durable)) AS now_rows, (SELECT max(seq) FROM c WHERE c.object = p.object AND c.seq <= p.since AND (c.durable OR NOT p.durable)) AS now_seq, "
    "(SELECT min(seq) FROM c WHERE c.object = p.object AND c.seq > p.since AND c.rows > 0 AND (c.durable OR NOT p.durable)) AS next_seq FROM p) SELECT poll, CASE WHEN now_rows > 0 THEN now_seq ELSE next_seq END AS fired FROM n"
)
def pl4_parked_polls(spark, d):
    """Polls over the users' logs: evaluated when parked and after every later commit of their object."""
    e = table(spark, d, "events")
    commits = e.select(F.col("user_id").alias("object"), F.col("event_id").alias("seq"), (F.col("event_type") != "click").alias("durable"), F.col("event_type").isin("error", "click").cast("int").alias("rows"))
    o = table(spark, d, "orders")
    waiting = o.select(F.col("o_orderkey").alias("poll"), F.col("o_custkey").alias("object"), (F.col("o_orderkey") % 10000).alias("since"), (F.col("o_orderkey") % 2 == 0).alias("durable"))
    return polls.parked(waiting, commits)


@code(
    "SELECT user_id AS object, event_id AS \"at\", durable, count(*) FILTER (WHERE event_type <> 'click' OR NOT durable) OVER (PARTITION BY user_id, durable ORDER BY event_id) AS checks FROM events CROSS JOIN (VALUES (true), (false)) t(durable)"
)
def pl5_rechecks(spark, d):
    """How often a poll of either kind has been looked at again after each write; a click touches temporary tables alone."""
    e = table(spark, d, "events").select(F.col("user_id").alias("object"), F.col("event_id").alias("at"), "event_type", F.explode(F.array(F.lit(True), F.lit(False))).alias("durable"))
    looked = ((F.col("event_type") != "click") | ~F.col("durable")).cast("long")
    return e.select("object", "at", "durable", F.sum(looked).over(Window.partitionBy("object", "durable").orderBy("at")).alias("checks"))


_POLL_EVENTS = "CASE event_type WHEN 'purchase' THEN 'fire' WHEN 'signup' THEN 'schema' WHEN 'error' THEN 'revert' WHEN 'click' THEN 'cancel' ELSE 'migrate' END"


@code(
    f"WITH ev AS (SELECT event_id AS t, {_POLL_EVENTS} AS kind, user_id % 40 AS conn, user_id AS object FROM events WHERE event_type <> 'view' OR event_id % 3 = 0), p AS (SELECT o_orderkey AS poll, o_custkey % 40 AS conn, o_custkey AS object, o_orderkey % 9000 AS since FROM orders), "
    "hit AS (SELECT poll, t, kind FROM p JOIN ev ON ev.object = p.object AND kind <> 'cancel' AND t > since UNION ALL SELECT poll, min(t), 'cancel' FROM p JOIN ev ON ev.conn = p.conn AND kind = 'cancel' AND t > since GROUP BY poll UNION ALL SELECT poll, 9500, 'shutdown' FROM p WHERE since < 9500), "
    "f AS (SELECT poll, arg_min(kind, (t, kind)) AS kind FROM hit GROUP BY poll) "
    "SELECT p.poll, CASE WHEN kind = 'fire' THEN 'answer' WHEN kind = 'schema' THEN 'error' WHEN kind = 'cancel' THEN 'dropped' WHEN kind IS NULL THEN NULL ELSE 're-poll' END AS reason FROM p LEFT JOIN f ON f.poll = p.poll"
)
def pl6_poll_lifecycle(spark, d):
    e = table(spark, d, "events").filter("event_type <> 'view' OR event_id % 3 = 0")  # two views in three change nothing
    events = e.select(F.col("event_id").alias("at"), F.expr(_POLL_EVENTS).alias("kind"), (F.col("user_id") % 40).alias("conn"), F.col("user_id").alias("object"))
    down = events.limit(0).union(spark.createDataFrame([(9500, "shutdown", None, None)], events.schema))
    o = table(spark, d, "orders")
    waiting = o.select(F.col("o_orderkey").alias("poll"), (F.col("o_custkey") % 40).alias("conn"), F.col("o_custkey").alias("object"), (F.col("o_orderkey") % 9000).alias("since"))
    return polls.ended(waiting, events.union(down))


@code(
    _FOLD + ", live AS (SELECT object, seq - CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS live_seq FROM ends), u AS (SELECT event_id, concat('u', cast(user_id AS VARCHAR)) AS object, CASE WHEN event_type = 'view' THEN 'read' ELSE 'write' END AS kind, event_type = 'error' AS dirty FROM events) "
    "SELECT event_id, kind, CASE WHEN kind = 'read' THEN coalesce(seq, 0) > coalesce(live_seq, 0) ELSE NOT dirty END AS refold FROM u LEFT JOIN live ON live.object = u.object LEFT JOIN ends ON ends.object = u.object"
)
def pl8_stale_refresh(spark, d):
    e = event_log(spark, d)
    done = log.committed_seq(e, outcomes(e))
    live = done.select("object", (F.col("seq") - (F.col("seq") % 3 == 0).cast("int")).alias("live_seq"))
    uses = e.select(F.col("txn").alias("event_id"), "object", F.when(F.col("payload") == "view", "read").otherwise("write").alias("kind"), (F.col("payload") == "error").alias("dirty"))
    return polls.stale(uses, live, done).select("event_id", "kind", "refold")


@code(
    "WITH e AS (SELECT l_orderkey AS batch, l_partkey AS object, bool_or(l_returnflag = 'R' AND l_linenumber = 1 AND l_quantity > 45) AS drops, bool_or(l_linenumber = 7 AND l_quantity > 40) AS moved FROM lineitem GROUP BY 1, 2), "
    "f AS (SELECT batch, count(*) AS n, min(CASE WHEN drops THEN object END) AS c, min(CASE WHEN NOT drops AND moved THEN object END) AS r FROM e GROUP BY batch), "
    "b AS (SELECT o_orderkey AS batch, o_totalprice AS bytes, o_orderkey % 10 = 1 AS early, o_orderkey % 10 = 2 AS lost FROM orders), "
    "x AS (SELECT b.*, n, CASE WHEN early THEN 'wait' WHEN lost THEN 'fenced' WHEN c IS NOT NULL THEN 'content ' || c WHEN r IS NOT NULL THEN 'rebase ' || r ELSE 'committed' END AS outcome FROM b LEFT JOIN f ON f.batch = b.batch) "
    "SELECT batch, bytes > 98304 AS staged, outcome, CASE WHEN outcome = 'committed' THEN coalesce(n, 0) ELSE 0 END AS entries FROM x"
)
def lg11_ship(spark, d):
    """Orders as batches, their parts as the objects that they write."""
    o = table(spark, d, "orders")
    batches = o.select(F.col("o_orderkey").alias("batch"), F.col("o_totalprice").alias("bytes"), F.lit(5).alias("fence"), F.when(F.col("o_orderkey") % 10 == 1, 4).otherwise(5).alias("now"), (F.col("o_orderkey") % 10 != 2).alias("leases"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("object"))
    entries = li.agg(F.bool_or(F.expr("l_returnflag = 'R' AND l_linenumber = 1 AND l_quantity > 45")).alias("drops"), F.bool_or(F.expr("l_linenumber = 7 AND l_quantity > 40")).alias("moved"))
    return log.ship(batches, entries.select("batch", "object", F.lit(3).alias("expected"), (F.lit(3) + F.col("moved").cast("int")).alias("seq"), "drops"))


@code(
    "WITH w AS (SELECT c_name AS session, c_nationkey = 7 AS closing FROM customer), p AS (SELECT o_orderkey AS poll, c_name AS session FROM orders JOIN customer ON c_custkey = o_custkey) "
    "SELECT 'fired' AS what, count(*) FILTER (WHERE closing) AS n FROM w UNION ALL SELECT 'armed', count(*) FILTER (WHERE NOT closing) FROM w UNION ALL SELECT 'parked', count(*) FROM p JOIN w ON w.session = p.session WHERE NOT closing"
)
def wl4_clean_close(spark, d):
    c = table(spark, d, "customer")
    waiting = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("poll"), F.col("c_name").alias("session"))
    fired, armed, parked = wills.closed(_wills(spark, d), c.filter("c_nationkey = 7").select(F.col("c_name").alias("session")), waiting)
    n = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n(fired, "fired").union(n(armed, "armed")).union(n(parked, "parked"))


_SECRET = b"a secret of this query"
_PAD = lambda x: bytes(b ^ x for b in _SECRET.ljust(64, b"\0")).hex()
_CLAIMS = "'{{\"grants\":[{{\"objects\":[\"' || n_name || '\"],\"verbs\":[\"read\"]}}],\"exp\":' || {exp} || '}}'"
_SIGNED = f"sha256(unhex('{_PAD(0x5C)}' || sha256(unhex('{_PAD(0x36)}' || hex(b)))))"


@code(
    f"WITH c AS (SELECT n_name, n_nationkey, {_CLAIMS.format(exp='n_nationkey')} AS c FROM nation), t AS (SELECT *, lower(hex(c)) AS b FROM c) "
    f"SELECT n_name, 'cap.' || b || '.' || {_SIGNED} AS token, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey > 10 THEN c END AS claims FROM t"
)
def gr1_tokens(spark, d):
    """Tokens of all nations, every fifth with a forged signature, read at time 10."""
    claims = F.concat(F.lit('{"grants":[{"objects":["'), "n_name", F.lit('"],"verbs":["read"]}],"exp":'), F.col("n_nationkey").cast("string"), F.lit("}"))
    token = grants.minted(claims, _SECRET)
    sent = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.substring(token, F.lit(1), F.length(token) - 1), F.lit("!"))).otherwise(token)
    return table(spark, d, "nation").select("n_name", token.alias("token"), grants.verified(sent, _SECRET, F.lit(10)).alias("claims"))


@code(
    "WITH r AS (SELECT event_id, ['txn', 'exec', 'query', 'poll', 'objects', 'stats', 'grant', 'nowhere'][event_id % 8 + 1] AS route, CASE user_id % 5 WHEN 0 THEN ['read'] WHEN 1 THEN ['insert', 'poll'] WHEN 2 THEN ['write'] WHEN 3 THEN ['ddl', 'read', 'poll'] END AS verbs, user_id % 7 = 0 AS root FROM events) "
    "SELECT event_id, route, coalesce(CASE WHEN root THEN route <> 'nowhere' WHEN route IN ('txn', 'exec') THEN list_has_any(verbs, ['insert', 'update', 'delete', 'ddl', 'write']) WHEN route = 'query' THEN list_contains(verbs, 'read') WHEN route = 'poll' THEN list_contains(verbs, 'poll') ELSE false END, false) AS allowed FROM r"
)
def gr5_routes(spark, d):
    names = F.array(*[F.lit(r) for r in ("txn", "exec", "query", "poll", "objects", "stats", "grant", "nowhere")])
    held = F.expr("CASE user_id % 5 WHEN 0 THEN array('read') WHEN 1 THEN array('insert', 'poll') WHEN 2 THEN array('write') WHEN 3 THEN array('ddl', 'read', 'poll') END")
    r = table(spark, d, "events").select("event_id", F.get(names, (F.col("event_id") % 8).cast("int")).alias("route"), held.alias("verbs"), (F.col("user_id") % 7 == 0).alias("root"))
    return r.select("event_id", "route", grants.route_gate(F.col("route"), F.col("verbs"), F.col("root")).alias("allowed"))


_OBJ = "CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN least(n_name, 'NATION_10') WHEN 2 THEN lower(n_name) END"


@code("SELECT n_name, CASE WHEN n_nationkey % 4 < 3 THEN cast(" + _FNV.format(o=f"({_OBJ})") + " % 64 AS BIGINT) END AS worker FROM nation")
def rt13_edge_router(spark, d):
    path = F.expr("CASE n_nationkey % 4 WHEN 0 THEN concat('/objects/', n_name, '/exec') WHEN 1 THEN '/txn' WHEN 2 THEN concat('/ws?x=1&for=', lower(n_name)) ELSE '/healthz' END")
    n = table(spark, d, "nation").select("n_name", path.alias("path"), F.array(F.col("n_name"), F.lit("NATION_10")).alias("objects"))
    return placement.edge_route(n, 64).select("n_name", "worker")


_SM = "cast((cast({a} AS UHUGEINT) * {m}) % 18446744073709551616 AS UBIGINT)"


@code(
    "WITH a AS (SELECT event_id, cast((cast(42 AS UHUGEINT) + cast(event_id + 1 AS UHUGEINT) * 11400714819323198485) % 18446744073709551616 AS UBIGINT) AS z FROM events), "
    "b AS (SELECT event_id, " + _SM.format(a="xor(z, z >> 30)", m=0xBF58476D1CE4E5B9) + " AS z FROM a), c AS (SELECT event_id, " + _SM.format(a="xor(z, z >> 27)", m=0x94D049BB133111EB) + " AS z FROM b) "
    "SELECT event_id, cast(xor(z, z >> 31) AS VARCHAR) AS r FROM c"
)
def sm1_split_mix(spark, d):
    """The seeded stream of the simulator: the number drawn at each event."""
    return table(spark, d, "events").select("event_id", F.conv(F.hex(scalar.split_mix(42, F.col("event_id") + 1)), 16, 10).alias("r"))


# ---- statements, run by the engine -----------------------------------------------------------


def _object(spark: SparkSession, **tables: tuple[DataFrame, list[str] | None]) -> Engine:
    """An engine whose object ``o`` holds the tables."""
    e = Engine(spark)
    for name, (df, key) in tables.items():
        e.load("o", name, df, key)
    return e


@code(BOTH["dm1_insert_rows"])
def dm1_insert_run(spark, d):
    e = _object(spark, t=(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), ["k"]))
    e.exec("o", "INSERT INTO t VALUES (?1, ?2), (101, 'newer')", [100, "new"])
    return e.query("o", "SELECT k, v FROM t")


@code(BOTH["dm2_insert_once"])
def dm2_insert_once_run(spark, d):
    e = _object(spark, events=(table(spark, d, "events").select("user_id", "event_type"), None), customer=(table(spark, d, "customer").select("c_custkey", "c_acctbal"), None))
    once = "INSERT INTO once SELECT user_id FROM events WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal > 5000) AND NOT EXISTS (SELECT 1 FROM once WHERE k = user_id) GROUP BY user_id"
    e.txn(["o"], [{"object": "o", "sql": s} for s in ("CREATE TABLE once (k INTEGER PRIMARY KEY)", once, once)])
    return e.query("o", "SELECT k FROM once")


@code(BOTH["dm3_insert_or_ignore"])
def dm3_insert_or_ignore_run(spark, d):
    e = _object(spark, events=(table(spark, d, "events").select("user_id", "event_id", "event_type"), None))
    e.txn(["o"], [{"object": "o", "sql": s} for s in ("CREATE TABLE seen (user_id INTEGER UNIQUE, event_id INTEGER, event_type TEXT)", "INSERT OR IGNORE INTO seen SELECT user_id, event_id, event_type FROM events ORDER BY event_id")])
    return e.query("o", "SELECT user_id, event_id, event_type FROM seen")


@code(BOTH["dm4_upsert"])
def dm4_upsert_run(spark, d):
    """The first event of each user, then the last one over it."""
    e = _object(spark, events=(table(spark, d, "events").select("user_id", "event_id", "event_type"), None))
    first = "INSERT INTO seen SELECT user_id, min(event_id), min_by(event_type, event_id) FROM events WHERE user_id % 2 = 0 GROUP BY user_id"
    last = "INSERT INTO seen SELECT user_id, max(event_id), max_by(event_type, event_id) FROM events GROUP BY user_id ON CONFLICT (user_id) DO UPDATE SET event_id = excluded.event_id, event_type = excluded.event_type"
    e.txn(["o"], [{"object": "o", "sql": s} for s in ("CREATE TABLE seen (user_id INTEGER UNIQUE, event_id INTEGER, event_type TEXT)", first, last)])
    return e.query("o", "SELECT user_id, event_id, event_type FROM seen")


@code(BOTH["dm5_update"])
def dm5_update_run(spark, d):
    e = _object(spark, c=(table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents")), None))
    e.exec("o", "UPDATE c SET cents = cents + ?1 WHERE c_mktsegment = 'BUILDING'", [100])
    return e.query("o", "SELECT c_custkey, cents FROM c")


@code(BOTH["dm6_delete"])
def dm6_delete_run(spark, d):
    e = _object(spark, orders=(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), None))
    e.exec("o", "DELETE FROM orders WHERE o_orderstatus = 'F'")
    return e.query("o", "SELECT o_orderkey FROM orders")


@code(BOTH["dm7_claim"])
def dm7_claim_run(spark, d):
    """A claim holds where nobody claimed before; a second one changes nothing."""
    clicks = table(spark, d, "events").filter("event_type = 'click'")
    e = _object(spark, slots=(clicks.select(F.col("user_id").alias("k"), F.lit(None).cast("long").alias("winner")).distinct(), ["k"]), clicks=(clicks.select("user_id", "event_id"), None))
    claim = "UPDATE slots SET winner = m.first FROM (SELECT user_id, {}(event_id) AS first FROM clicks GROUP BY user_id) m WHERE m.user_id = k AND winner IS NULL"
    e.txn(["o"], [{"object": "o", "sql": claim.format(f)} for f in ("min", "max")])
    return e.query("o", "SELECT k, winner FROM slots")


@code(BOTH["dm8_update_from"])
def dm8_update_from_run(spark, d):
    e = _object(spark, c=(table(spark, d, "customer").select("c_custkey", F.lit(0).cast("long").alias("orders_n")), None), orders=(table(spark, d, "orders").select("o_custkey"), None))
    e.exec("o", "UPDATE c SET orders_n = m.n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) m WHERE m.o_custkey = c_custkey")
    return e.query("o", "SELECT c_custkey, orders_n FROM c")


@code(BOTH["dm8_replace"])
def dm8_replace_run(spark, d):
    e = _object(spark, nation=(table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name"), None))
    e.txn(["o"], [{"object": "o", "sql": s} for s in ("CREATE TABLE t (k INTEGER UNIQUE, v TEXT)", "REPLACE INTO t SELECT n_regionkey, n_name FROM nation WHERE n_nationkey < 9", "INSERT OR REPLACE INTO t SELECT n_regionkey, n_name FROM nation ORDER BY n_nationkey")])
    return e.query("o", "SELECT cast(k AS int) AS k, v FROM t")


@code(BOTH["dm8_returning"])
def dm8_returning_run(spark, d):
    e = _object(spark, orders=(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), None))
    return e.exec("o", "UPDATE orders SET o_custkey = o_custkey + 1 WHERE o_orderstatus = 'P' RETURNING o_orderkey, o_custkey", frames=True)["rows"]


@code(BOTH["dm8_delete_limit"])
def dm8_delete_limit_run(spark, d):
    e = _object(spark, orders=(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), None))
    e.exec("o", "DELETE FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")
    return e.query("o", "SELECT o_orderkey FROM orders")


@code("SELECT * FROM (VALUES (0, 'id', 'bigint', 0, NULL, 1), (1, 'n', 'bigint', 1, '7', 0), (2, 'body', 'string', 0, NULL, 0), (3, 'any', 'string', 0, NULL, 0)) t(cid, name, type, \"notnull\", dflt_value, pk)")
def dd1_create_table(spark, d):
    """What a declaration amounts to, read back by PRAGMA table_info."""
    e = Engine(spark)
    e.exec("o", "CREATE TABLE IF NOT EXISTS t (id INTEGER PRIMARY KEY AUTOINCREMENT, n INTEGER NOT NULL DEFAULT 7 CHECK (n > 0), body TEXT UNIQUE, any)")
    rows = e.exec("o", "PRAGMA table_info(t)")["rows"]
    return spark.createDataFrame([tuple(r.values()) for r in rows], "cid int, name string, type string, notnull int, dflt_value string, pk int")


@code("SELECT count(DISTINCT user_id) AS typing_n, (SELECT count(*) FROM events) AS events_n, cast(0 AS BIGINT) AS elsewhere FROM events WHERE event_type = 'click'")
def dd2_temp_table(spark, d):
    """A temporary table beside one that lasts; it isn't in the log, so another engine over the folder has none."""
    e = _object(spark, events=(table(spark, d, "events").select("user_id", "event_type"), None))
    e.txn(["o"], [{"object": "o", "sql": s} for s in ("CREATE TEMP TABLE typing (u INTEGER PRIMARY KEY)", "INSERT OR IGNORE INTO typing SELECT user_id FROM events WHERE event_type = 'click'")])
    other = Engine(spark, root=e.root)
    there = sum("typing" in db.tables for db in (*other.databases.values(), *other.temps.values()))
    return e.query("o", f"SELECT (SELECT count(*) FROM typing) AS typing_n, (SELECT count(*) FROM events) AS events_n, cast({there} AS bigint) AS elsewhere")


@code("SELECT n_name AS v, 'no such table' AS gone FROM nation")
def dd3_drop_table(spark, d):
    """A table dropped in one object stays in another."""
    e = _object(spark, t=(table(spark, d, "nation").select(F.col("n_name").alias("v")), None))
    e.load("p", "t", table(spark, d, "region").select(F.col("r_name").alias("v")))
    e.exec("p", "DROP TABLE t")
    try:
        e.query("p", "SELECT * FROM t")
        gone = "still there"
    except UserError as x:
        gone = str(x)[:13]
    return e.query("o", f"SELECT v, '{gone}' AS gone FROM t")


@code("SELECT n_name AS note, n_nationkey + 1 AS n FROM nation WHERE n_nationkey % 2 = 0")
def dd4_trigger(spark, d):
    """Every row that goes in is noted by a trigger, if its number is even."""
    e = _object(spark, nation=(table(spark, d, "nation").select("n_name", "n_nationkey"), None))
    ddl = ("CREATE TABLE t (n INTEGER, v TEXT)", "CREATE TABLE audit (note TEXT, n INTEGER)", "CREATE TRIGGER a AFTER INSERT ON t WHEN NEW.n % 2 = 0 BEGIN INSERT INTO audit VALUES (NEW.v, NEW.n + 1); END")
    e.txn(["o"], [{"object": "o", "sql": s} for s in (*ddl, "INSERT INTO t SELECT n_nationkey, n_name FROM nation")])
    return e.query("o", "SELECT note, cast(n AS int) AS n FROM audit")


@code(BOTH["dd5_view"])
def dd5_view_run(spark, d):
    e = _object(spark, orders=(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), None))
    e.txn(["o"], [{"object": "o", "sql": s} for s in ("CREATE VIEW big_orders AS SELECT * FROM orders WHERE o_totalprice > 200000", "ALTER TABLE orders ADD COLUMN note TEXT DEFAULT 'x'", "CREATE INDEX by_price ON orders (o_totalprice)", "SAVEPOINT s", "DELETE FROM orders", "ROLLBACK TO s")])
    return e.query("o", "SELECT o_orderstatus, count(*) AS n FROM big_orders GROUP BY o_orderstatus")


@code("SELECT n_regionkey AS object, count(*) AS n, cast(sum(n_nationkey) AS BIGINT) AS s FROM nation WHERE n_regionkey <> 2 GROUP BY n_regionkey")
def sc3_materialise(spark, d):
    """Objects forgotten and read from the log again, one of them purged; then all of them in one scan."""
    n = table(spark, d, "nation")
    e = Engine(spark)
    for r in range(5):
        e.load(f"r{r}", "t", n.filter(F.col("n_regionkey") == r).select("n_nationkey", F.col("n_regionkey").alias("r")))
    e.purge("r2")
    e.compact()
    e.evict("r1")
    return e.table("t").groupBy(F.substring("object", 2, 1).cast("int").alias("object")).agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("s"))


@code("SELECT 'alice' AS object, 40 AS balance, 1 AS msgs UNION ALL SELECT 'bob', 160, 1")
def dl_outbox(spark, d):
    """A transfer and its messages in one transaction wake the subscriber; one that fails leaves neither."""
    e = Engine(spark)
    for o in ("alice", "bob"):
        e.txn([o], [{"object": o, "sql": s} for s in ("CREATE TABLE account (balance INTEGER CHECK (balance >= 0))", "INSERT INTO account VALUES (100)", "CREATE TABLE msgs (id INTEGER PRIMARY KEY AUTOINCREMENT, k TEXT UNIQUE)")])
    waiting = [e.park(o, "SELECT count(*) AS n FROM msgs HAVING count(*) > 0") for o in ("alice", "bob")]
    for k, amt in (("k1", 60), ("k2", 500)):
        ops = [{"object": o, "sql": s, "params": p} for o, sign in (("alice", -1), ("bob", 1)) for s, p in (("INSERT OR IGNORE INTO msgs (k) VALUES (?1)", [k]), ("UPDATE account SET balance = balance + ?1", [sign * amt]))]
        try:
            e.txn(["alice", "bob"], ops)
        except UserError:
            pass  # the second one overdraws
    rows = [(o, e.query(o, "SELECT balance FROM account").first()[0], p.wait(0)["rows"][0]["n"]) for o, p in zip(("alice", "bob"), waiting, strict=True)]
    return spark.createDataFrame(rows, "object string, balance int, msgs int")


# ---- whole tables without SQL ----------------------------------------------------------------


def whole_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(txn, object): all orders and all their parts, which are one large component or a few."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("object")).distinct()


@code()
def tx6_components_whole(spark, d):
    return txn.transaction_components(whole_graph(spark, d))


@code()
def tx8_revert_closure_whole(spark, d):
    g = whole_graph(spark, d)
    return txn.revert_closure(g, g.filter("object like '%3'").select("object"))


#: Queries that read a part of a table, because their SQL could not read more; the ones beside them, named ..._whole, read
#: all of it. Only those are registered; these are what tests hold them against.
PARTS = ("df23_trace_hash", "so3_nocase", "tx6_components", "tx8_revert_closure")


def registered() -> dict[str, Query]:
    return {name: f for name, f in queries().items() if name not in PARTS}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name, text in BOTH.items():
        out[name] = lambda spark, d, text=text: sql(spark, d, text)
    for name, (text, _) in PAIRS.items():
        out[name] = lambda spark, d, text=text: sql(spark, d, text)
    for name, (f, _) in CODE.items():
        out[name] = f
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(BOTH)
    out |= {name: text for name, (_, text) in PAIRS.items()}
    out |= {name: text for name, (_, text) in CODE.items() if text is not None}
    return out
