"""Queries of the engine by operator, over the test tables in shards, with SQL for the same rows unsharded."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ctl import split
from .dialect.ddl import translate
from .engine import Engine
from .errors import NotFound
from .functions.vindex import create
from .plans.vschema import VSchema
from .sources.store import Store, Stored
from .streaming.windows import windowed

SCHEMA = {
    "keyspaces": {
        "commerce": {
            "sharded": True,
            "shards": 4,
            "vindexes": {
                "hash": {"type": "hash"},
                "by_kind": {"type": "multicol", "params": {"column_count": "2", "column_vindex": "xxhash,hash"}},
                "nation_lookup": {"type": "lookup_hash", "params": {"table": "main.nation_lookup", "from": "s_nationkey", "to": "s_suppkey"}, "owner": "supplier"},
                "order_lookup": {"type": "consistent_lookup_unique", "params": {"table": "places.order_lookup", "from": "o_orderkey", "to": "keyspace_id"}, "owner": "orders"},
                "name_lookup": {"type": "lookup_unique", "params": {"table": "main.name_lookup", "from": "c_name", "to": "keyspace_id"}, "owner": "customer"},
            },
            "tables": {
                "customer": {"buckets": 8, "primary_key": ["c_custkey"], "column_vindexes": [{"column": "c_custkey", "name": "hash"}, {"column": "c_name", "name": "name_lookup"}]},
                "orders": {"buckets": 8, "primary_key": ["o_orderkey"], "column_vindexes": [{"column": "o_custkey", "name": "hash"}, {"column": "o_orderkey", "name": "order_lookup"}]},
                "lineitem": {"column_vindexes": [{"column": "l_orderkey", "name": "hash"}]},
                "supplier": {"primary_key": ["s_suppkey"], "column_vindexes": [{"column": "s_suppkey", "name": "hash"}, {"column": "s_nationkey", "name": "nation_lookup"}]},
                "events": {"column_vindexes": [{"columns": ["event_type", "user_id"], "name": "by_kind"}]},
                "nation": {"type": "reference"},
                "region": {"type": "reference", "primary_key": ["r_regionkey"]},
                "ticket": {"primary_key": ["id"], "column_vindexes": [{"column": "id", "name": "hash"}], "auto_increment": {"column": "id", "sequence": "main.ticket_seq"}},
            },
        },
        "catalog": {
            "sharded": True,
            "shards": ["-0000000000000400", "0000000000000400-"],
            "vindexes": {"numeric": {"type": "numeric"}},
            "tables": {"part": {"primary_key": ["p_partkey"], "column_vindexes": [{"column": "p_partkey", "name": "numeric"}]}},
        },
        "brands": {
            "sharded": True,
            "shards": ["-4272616e642333", "4272616e642333-"],
            "vindexes": {"binary": {"type": "binary"}},
            "tables": {"brand_part": {"column_vindexes": [{"column": "p_brand", "name": "binary"}]}},
        },
        "days": {
            "sharded": True,
            "shards": 4,
            "vindexes": {"xxhash": {"type": "xxhash"}},
            "tables": {"order_day": {"column_vindexes": [{"column": "o_day", "name": "xxhash"}]}, "order_price": {"column_vindexes": [{"column": "price", "name": "xxhash"}]}},
        },
        "places": {
            "sharded": True,
            "shards": 2,
            "vindexes": {"binary_md5": {"type": "binary_md5"}},
            "tables": {"order_lookup": {"column_vindexes": [{"column": "o_orderkey", "name": "binary_md5"}]}},
        },
        "main": {
            "tables": {**{t: {} for t in ("documents", "labels", "pages", "conversations", "benchmark", "embeddings", "name_lookup", "nation_lookup")}, "ticket_seq": {"type": "sequence"}},
        },
    }
}
SOURCES = {"brand_part": "part"}
ATTACHED = ("nation", "region", "documents", "labels", "pages", "conversations", "benchmark", "embeddings")

_ENGINES: dict[tuple[str, str], Engine] = {}


def shared_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named.rstrip("/") if named else "file://" + tempfile.mkdtemp(prefix="shardloom-")) + f"/store-{uuid.uuid4().hex}"


def engine_for(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    """An engine whose store has these tables of a folder; a table is sharded when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ENGINES:
        _ENGINES[key] = Engine(spark, VSchema(SCHEMA), Store(spark, shared_root(spark)))
    engine = _ENGINES[key]
    for t in tables:
        table = engine.vschema.find(t)
        if table.full_name in engine.store.tables:
            continue
        path = f"{sf_dir}/{SOURCES.get(t, t)}.parquet"
        if t in ATTACHED:
            engine.attach(t, path)
        else:
            engine.load(t, spark.read.parquet(path))
        for cv in table.vindexes:
            if cv.owner:
                engine.load(cv.vindex.table, engine.writer.lookup_rows(table, cv, engine.table(t)))
    return engine


#: Statements that give the same rows on the unsharded tables.
SQL = {
    "route_equal_unique": ("customer", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42"),
    "route_in": ("orders", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_totalprice) AS DECIMAL(18,2)) AS total FROM orders WHERE o_custkey IN (1, 4, 7) GROUP BY o_orderstatus ORDER BY 1"),
    "route_multi_equal": ("customer", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 3 OR c_custkey = 11 OR c_custkey = 700"),
    "route_row_values": ("events", "SELECT event_id, event_type, user_id FROM events WHERE (event_type, user_id) IN (('click', 5), ('purchase', 9), ('view', 17))"),
    "route_partial_multicol": ("events", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id"),
    "route_range_numeric": ("part", "SELECT p_partkey, p_name FROM part WHERE p_partkey BETWEEN 1000 AND 1010"),
    "route_range_open": ("part", "SELECT count(*) AS n, min(p_partkey) AS lo FROM part WHERE p_partkey >= 1500"),
    "route_prefix_binary": ("brand_part", "SELECT p_brand, count(*) AS n FROM brand_part WHERE p_brand LIKE 'Brand#1%' GROUP BY p_brand"),
    "route_scatter": ("orders", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000"),
    "route_none": ("customer", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 1 AND c_custkey IS NULL"),
    "route_lookup": ("customer", "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007'"),
    "route_lookup_hash": ("supplier", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3"),
    "route_lookup_consistent": ("orders", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey = 77"),
    "route_lookup_in": ("orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (3, 77, 1024, -5)"),
    "route_flipped_and": ("customer", "SELECT c_custkey, c_name FROM customer WHERE 42 = c_custkey AND c_acctbal > -100000"),
    "route_cast": ("customer", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = CAST('42' AS BIGINT)"),
    "route_coerced_double": ("customer", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7e0"),
    "route_coerced_decimal": ("customer", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (7.0, 8.00, 9.5)"),
    "route_coerced_text": ("customer", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = '07' OR c_custkey = CAST('08' AS BIGINT)"),
    "route_negated": ("customer", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (1, 2, 3) AND c_name NOT LIKE 'Customer#00000000%'"),
    "route_or_with_rest": ("orders", "SELECT o_orderkey FROM orders WHERE (o_custkey = 5 OR o_custkey = 9) AND o_orderstatus = 'F'"),
    "route_bad_branch": ("customer", "SELECT c_custkey FROM customer WHERE c_custkey = 5 OR c_nationkey = 7"),
    "route_range_half": ("part", "SELECT count(*) AS n FROM part WHERE p_partkey < 300 AND p_partkey > 20"),
    "route_any_shard": ("nation", "SELECT 1 AS one, 'x' AS letter"),
    "route_values": ("nation", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(n, letter)"),
    "route_subquery_block": ("customer orders", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey IN (3, 8, 21))"),
    "route_reference": ("nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "unsharded_scan": ("documents", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang"),
    "agg_count_star": ("lineitem", "SELECT count(*) AS n FROM lineitem"),
    "agg_count_col": ("orders", "SELECT count(NULLIF(o_orderstatus, 'F')) AS n FROM orders"),
    "agg_sum": ("lineitem", "SELECT CAST(sum(l_orderkey) AS BIGINT) AS s, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS q FROM lineitem"),
    "agg_min_max": ("orders", "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderpriority) AS first FROM orders"),
    "agg_avg": ("customer", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment"),
    "agg_count_distinct": ("orders", "SELECT count(DISTINCT o_custkey) AS n FROM orders"),
    "agg_nested": ("lineitem", "SELECT l_returnflag, round(sum(l_extendedprice) / count(*), 4) AS mean FROM lineitem GROUP BY l_returnflag"),
    "agg_sum_wide": ("orders", "SELECT CAST(sum(CAST(o_orderkey + 9000000000000000000 AS DECIMAL(20,0))) AS DECIMAL(30,0)) AS s FROM orders"),
    "agg_avg_exact": ("orders", "SELECT o_orderstatus, CAST(sum(o_custkey) AS DECIMAL(18,0)) AS s, count(o_custkey) AS n, round(avg(o_custkey), 6) AS mean FROM orders GROUP BY o_orderstatus"),
    "agg_distinct_several": ("lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS l FROM lineitem GROUP BY l_returnflag"),
    "agg_filtered": ("orders", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_totalprice > 1000) AS p FROM orders"),
    "agg_spread": ("customer", "SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS v FROM customer GROUP BY c_mktsegment"),
    "agg_text": ("customer", "SELECT min(c_name) AS lo, max(c_name) AS hi, count(DISTINCT substr(c_name, 1, 12)) AS n FROM customer"),
    "agg_dates": ("orders", "SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders"),
    "agg_empty_group": ("orders", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice < -1 GROUP BY o_orderstatus"),
    "group_by_all": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL"),
    "group_by_null": ("orders", "SELECT NULLIF(o_orderstatus, 'O') AS s, count(*) AS n FROM orders GROUP BY 1"),
    "group_by_expression": ("orders", "SELECT o_custkey % 7 AS k, count(*) AS n, max(o_orderkey) AS hi FROM orders GROUP BY o_custkey % 7"),
    "group_rollup": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "group_sets": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "agg_empty": ("orders", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, max(o_totalprice) AS hi FROM orders WHERE o_totalprice < -1"),
    "group_by": ("orders", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority"),
    "group_by_hidden_key": ("orders", "SELECT count(*) AS n FROM orders GROUP BY o_orderpriority"),
    "group_by_ordinal": ("lineitem", "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1"),
    "group_order_limit": ("orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10"),
    "having": ("orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    "distinct": ("orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "distinct_order_limit": ("customer", "SELECT DISTINCT c_nationkey FROM customer ORDER BY c_nationkey DESC LIMIT 5"),
    "order_by": ("supplier", "SELECT s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_name"),
    "order_by_hidden": ("customer", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7"),
    "order_nulls": ("orders", "SELECT o_orderkey, NULLIF(o_orderstatus, 'O') AS s FROM orders ORDER BY s NULLS FIRST, o_orderkey LIMIT 20"),
    "limit_offset": ("orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25"),
    "order_ordinal": ("supplier", "SELECT s_nationkey, s_name FROM supplier ORDER BY 1 DESC, 2 LIMIT 15"),
    "order_star": ("customer", "SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 9"),
    "order_nulls_last": ("orders", "SELECT o_orderkey, NULLIF(o_orderstatus, 'O') AS s FROM orders ORDER BY s DESC NULLS LAST, o_orderkey DESC LIMIT 20"),
    "limit_zero": ("customer", "SELECT c_custkey FROM customer LIMIT 0"),
    "distinct_star": ("nation region", "SELECT DISTINCT n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "parenthesised": ("supplier", "(SELECT s_suppkey FROM supplier WHERE s_suppkey < 5)"),
    "offset_only": ("supplier", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 90"),
    "union": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "union_order_limit": ("customer supplier", "SELECT c_custkey AS k FROM customer WHERE c_custkey = 9 UNION SELECT s_suppkey FROM supplier ORDER BY k DESC LIMIT 4"),
    "union_nested": ("customer supplier nation", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION SELECT n_nationkey + 20 FROM nation"),
    "union_null_keys": ("orders", "SELECT NULLIF(o_orderstatus, 'O') AS s FROM orders UNION SELECT '' AS s"),
    "except_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "except_": ("customer orders", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000"),
    "intersect_": ("customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "join_collocated": ("customer orders", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment"),
    "join_collocated_pinned": ("customer orders", "SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_custkey = 17"),
    "join_cross_inner": ("orders lineitem", "SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45 GROUP BY o_orderpriority"),
    "join_cross_left": ("orders lineitem", "SELECT o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 49 GROUP BY o_orderkey"),
    "join_cross_keyspace": ("lineitem part", "SELECT p_brand, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"),
    "join_three_way": ("customer orders nation", "SELECT n_name, count(*) AS n FROM customer, orders, nation WHERE c_custkey = o_custkey AND c_nationkey = n_nationkey GROUP BY n_name"),
    "join_right": ("supplier nation", "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"),
    "join_full": ("customer orders", "SELECT count(*) AS n, count(c_custkey) AS c, count(o_orderkey) AS o FROM (SELECT * FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey"),
    "join_semi": ("customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "join_anti": ("customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "join_using": ("orders", "SELECT count(*) AS n FROM orders a JOIN orders b USING (o_orderkey)"),
    "join_self_sharding_key": ("orders", "SELECT a.o_custkey, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY a.o_custkey"),
    "join_collocated_left": ("customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey"),
    "join_collocated_distinct": ("customer orders", "SELECT count(DISTINCT c_custkey) AS n FROM customer, orders WHERE c_custkey = o_custkey AND o_orderstatus = 'F'"),
    "join_cross_order_limit": ("orders lineitem", "SELECT o_orderkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey ORDER BY l_extendedprice DESC, o_orderkey, l_linenumber LIMIT 12"),
    "join_left_where_right": ("customer orders", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL"),
    "join_four_way": ("customer orders lineitem supplier", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = c_nationkey GROUP BY c_mktsegment"),
    "join_theta": ("nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey"),
    "join_cross_product": ("nation region", "SELECT count(*) AS n FROM nation CROSS JOIN region"),
    "join_reference": ("supplier nation region", "SELECT r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "window_rank": ("orders", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders"),
    "window_running": ("orders", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders"),
    "window_share": ("customer", "SELECT c_custkey, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 8) AS share FROM customer WHERE c_acctbal > 0"),
    "subquery_scalar": ("customer orders", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "subquery_correlated": ("customer orders", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last FROM customer"),
    "subquery_other_shard": ("customer supplier", "SELECT c_custkey FROM customer WHERE c_custkey = 4 AND c_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "functions": ("customer", "SELECT c_custkey, upper(c_mktsegment) AS u, length(c_name) AS l, coalesce(NULLIF(c_nationkey, 3), -1) AS k, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS state, abs(c_acctbal) AS a FROM customer"),
    "subquery_in": ("customer orders", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)"),
    "subquery_derived": ("orders", "SELECT max(n) AS most FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t"),
    "cte": ("orders customer", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c_name, round(s, 2) AS s FROM customer JOIN big ON c_custkey = o_custkey WHERE s > 2000000"),
    "pricing_summary": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DECIMAL(22,4)) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"),
}

#: Golden values of sharding functions.
VALUES = {"hash": [0, 1, 2, 3, 4, 5, 6, -1, 42, 100], "xxhash": ["test1", "test2", 1, -1], "numeric": [0, 1, 255, -1], "reverse_bits": [1, 6, 0, -1], "binary_md5": ["a", "abc", ""], "binary": ["abc", "é"]}
GOLDEN = {
    "hash": "8ca64de9c1b123a7 166b40b44aba4bd6 06e7ea22ce92708f 4eb190c9a2fa169c d2fd8867d50d2dfe 70bb023c810ca87a f098480ac4c4be71 355550b2150e2451 61f0f4f610d0a79a 83aab1569cbe1b08".split(),
    "xxhash": "d01ab7e4d6978f0b 87eb11714c0a0e89 d46405367612b4b7 d8e2a6a7c8c7623d".split(),
    "numeric": "0000000000000000 0000000000000001 00000000000000ff ffffffffffffffff".split(),
    "reverse_bits": "8000000000000000 6000000000000000 0000000000000000 ffffffffffffffff".split(),
    "binary_md5": "0cc175b9c0f1b6a831c399e269772661 900150983cd24fb0d6963f7d28e17f72 d41d8cd98f00b204e9800998ecf8427e".split(),
    "binary": "616263 c3a9".split(),
}


def sql_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    tables, text = SQL[name]
    return lambda spark, sf_dir: engine_for(spark, sf_dir, *tables.split()).sql(text)


def vindex_query(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        values = spark.createDataFrame([(str(v),) for v in VALUES[kind]], "v string")
        return values.select("v", F.lower(F.hex(create(kind, kind).ksid(F.col("v")))).alias("ksid"))

    return run


def scratch(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    """An engine of its own over a copy of the manifest, for writes."""
    base = engine_for(spark, sf_dir, *tables)
    engine = Engine(spark, VSchema(SCHEMA), Store(spark, shared_root(spark)))
    engine.store.commit({n: t.copy() for n, t in base.store.tables.items()})
    return engine


def days(spark: SparkSession, sf_dir: str) -> Engine:
    """Orders by their day and by their price."""
    engine = engine_for(spark, sf_dir)
    if "days.order_day" not in engine.store.tables:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        engine.load("order_day", orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_day")))
        engine.load("order_price", orders.select("o_orderkey", F.floor("o_totalprice").cast("decimal(10,2)").alias("price")))
    return engine


def route_coerced_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir).sql("SELECT o_orderkey FROM order_day WHERE o_day = '1995-01-05' OR o_day = '1995-1-6'")


def route_coerced_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = days(spark, sf_dir)
    return e.sql("SELECT o_orderkey, price FROM order_price WHERE price = (SELECT max(price) FROM order_price) OR price = 1000 OR price = 1234.0")


def route_coerced_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_for(spark, sf_dir, "customer").sql("SELECT c_custkey, c_name FROM customer WHERE c_custkey = ?", [7.0])


def dml_delete_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "customer")
    e.sql("DELETE FROM customer WHERE c_custkey = 7e0")
    e.sql("UPDATE customer SET c_mktsegment = 'none' WHERE c_custkey = '08'")
    return e.sql("SELECT c_custkey, c_mktsegment FROM customer")


def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "supplier")
    e.sql("INSERT INTO supplier (s_suppkey, s_name, s_nationkey, s_acctbal) VALUES (900001, 'new one', 3, 1.5), (900002, 'new two', 4, 2.5)")
    return e.sql("SELECT s_suppkey, s_name, s_nationkey FROM supplier")


def dml_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "supplier")
    e.sql("INSERT INTO supplier (s_suppkey, s_name, s_nationkey, s_acctbal) SELECT s_suppkey + 500000, s_name, s_nationkey, s_acctbal FROM supplier")
    return e.sql("SELECT s_suppkey, s_name, s_nationkey FROM supplier")


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "supplier")
    e.sql("UPDATE supplier SET s_nationkey = s_nationkey + 100, s_name = 'moved' WHERE s_acctbal > 0")
    return e.sql("SELECT s_suppkey, s_name, s_nationkey FROM supplier")


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "orders")
    e.sql("DELETE FROM orders WHERE NULLIF(o_orderstatus, 'O') = 'F'")
    return e.sql("SELECT o_orderkey, o_orderstatus FROM orders")


def dml_lookup_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "customer")
    e.sql("UPDATE customer SET c_name = 'renamed' WHERE c_custkey = 5")
    return e.sql("SELECT c_custkey, c_name FROM customer WHERE c_name = 'renamed'")


def transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "supplier")
    e.sql("BEGIN")
    e.sql("DELETE FROM supplier WHERE s_suppkey < 10")
    e.sql("COMMIT")
    e.sql("BEGIN")
    e.sql("DELETE FROM supplier")
    e.sql("ROLLBACK")
    return e.sql("SELECT s_suppkey FROM supplier")


def sequence_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "supplier")
    ticket, seq = e.vschema.find("ticket"), e.vschema.find("ticket_seq")
    e.store.commit({ticket.full_name: Stored(spark.createDataFrame([], "id long, note string").schema.json())})
    e.load(seq.full_name, spark.createDataFrame([(0, 100)], "id long, next_id long"))
    e.sql("INSERT INTO ticket (note) VALUES ('a'), ('b')")
    e.sql("INSERT INTO ticket (id, note) VALUES (NULL, 'c'), (7, 'd')")
    return e.sql("SELECT id, note FROM ticket")


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each shard of a table that is sharded by MD5."""
    return engine_for(spark, sf_dir, "orders").table("order_lookup", with_shard=True).groupBy(F.col("__shard").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_for(spark, sf_dir).sql("SHOW TABLES FROM commerce")


def vexplain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_for(spark, sf_dir, "orders").sql("VEXPLAIN SELECT o_orderstatus, count(*) FROM orders WHERE o_custkey IN (1, 4, 7) GROUP BY o_orderstatus")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return windowed(events, "ts", "1 hour", "10 minutes", ["event_type"], F.count(F.lit(1)).alias("n")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def vindex_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = spark.createDataFrame([("a",), ("1",)], "v string")
    return values.select("v", F.lower(F.hex(create("null", "null").ksid(F.col("v")))).alias("ksid"))


def vindex_multicol(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = create("multicol", "both", {"column_count": "2"})
    values = spark.createDataFrame([(1, 2), (4, 3)], "a long, b long")
    return values.select("a", "b", F.lower(F.hex(both.ksid(F.col("a"), F.col("b")))).alias("ksid"))


def vindex_static_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = create("numeric_static_map", "mapped", {"json": '{"1": 100, "7": 255}', "fallback_type": "hash"})
    values = spark.createDataFrame([(1,), (7,), (2,)], "v long")
    return values.select("v", F.lower(F.hex(mapped.ksid(F.col("v")))).alias("ksid"))


def lookup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_for(spark, sf_dir, "supplier").sql("SELECT s_nationkey, s_suppkey FROM nation_lookup")


def range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine_for(spark, sf_dir, "part").table("part", with_shard=True)
    return rows.groupBy(F.col("__shard").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))


def use_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "part")
    e.sql("USE `catalog:0000000000000400-`")
    return e.sql("SELECT p_partkey, p_name FROM part")


def route_any_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_for(spark, sf_dir, "orders").sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = ANY(ARRAY[1, 4, 7])")


def route_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_for(spark, sf_dir, "orders").sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (?, ?) AND o_orderstatus <> ?", [11, 25, "F"])


def limit_mysql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_for(spark, sf_dir, "orders").sql('SELECT "o_orderkey" FROM orders ORDER BY o_orderkey LIMIT 25, 10'.replace('"', "`"))


def dml_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "supplier")
    e.sql("INSERT IGNORE INTO supplier (s_suppkey, s_name, s_nationkey, s_acctbal) VALUES (1, 'there', 3, 1.5), (900003, 'not yet', 4, 2.5)")
    e.sql("INSERT INTO supplier (s_suppkey, s_name, s_nationkey, s_acctbal) VALUES (2, 'there', 3, 1.5) ON CONFLICT DO NOTHING")
    return e.sql("SELECT s_suppkey, s_name, s_nationkey FROM supplier")


NEW_ORDERS = "(o_orderkey, o_custkey, o_orderstatus) VALUES (1, 1, 'N'), (90000001, 1, 'N'), (90000002, 1, 'N'), (90000002, 1, 'M')"


def dml_insert_ignore_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a sharding key that is there are new ones; those of a key that is there are not."""
    e = scratch(spark, sf_dir, "orders")
    e.sql("INSERT IGNORE INTO orders " + NEW_ORDERS)
    return e.sql("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")


def dml_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "supplier")
    e.sql("REPLACE INTO supplier (s_suppkey, s_name, s_nationkey, s_acctbal) VALUES (1, 'first', 3, 1.5), (900004, 'new', 4, 2.5), (1, 'last', 5, 3.5)")
    return e.sql("SELECT s_suppkey, s_name, s_nationkey FROM supplier")


def dml_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "supplier")
    e.sql("INSERT INTO supplier (s_suppkey, s_name, s_nationkey, s_acctbal) VALUES (2, 'there', 3, 1.5), (900005, 'new', 4, 2.5) ON DUPLICATE KEY UPDATE s_name = concat(s_name, '/', VALUES(s_name)), s_nationkey = s_nationkey + 100")
    e.sql("INSERT INTO supplier (s_suppkey, s_name) VALUES (3, 'x'), (4, 'y') ON CONFLICT (s_suppkey) DO UPDATE SET s_name = EXCLUDED.s_name WHERE EXCLUDED.s_name <> 'y'")
    return e.sql("SELECT s_suppkey, s_name, s_nationkey FROM supplier")


def dml_upsert_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upsert changes can be found by its lookup, and no longer by the old value."""
    e = scratch(spark, sf_dir, "supplier")
    e.sql("INSERT INTO supplier (s_suppkey, s_name, s_nationkey) VALUES (2, 'there', 3) ON DUPLICATE KEY UPDATE s_nationkey = 77")
    return e.sql("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (77, 78)")


def ddl_if_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "customer")
    e.sql("CREATE TABLE IF NOT EXISTS commerce.customer (c_custkey BIGINT)")
    return e.sql("SELECT count(*) AS n FROM customer")


def ddl_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is dropped is unknown until it is made again."""
    e = scratch(spark, sf_dir, "supplier")
    e.sql("DROP TABLE commerce.supplier")
    e.sql("DROP TABLE IF EXISTS commerce.supplier")
    try:
        e.sql("SELECT * FROM supplier")
        found = "there"
    except NotFound:
        found = "gone"
    e.sql("CREATE TABLE commerce.supplier (s_suppkey BIGINT PRIMARY KEY, s_nationkey INT)")
    e.sql(f"INSERT INTO supplier (s_suppkey, s_nationkey) VALUES ({len(found)}, 1)")
    return e.sql("SELECT s_suppkey, s_nationkey FROM supplier")


def ddl_alter_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "supplier")
    e.sql("ALTER TABLE commerce.supplier RENAME COLUMN s_name TO label, MODIFY s_acctbal DECIMAL(12,1), ADD COLUMN note VARCHAR(9)")
    e.sql("ALTER TABLE commerce.supplier DROP COLUMN note, ADD COLUMN note INT")
    return e.sql("SELECT s_suppkey, label, note FROM supplier")


def ddl_unique_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "supplier")
    e.sql("CREATE UNIQUE INDEX by_name ON commerce.supplier (s_name)")
    e.sql("INSERT IGNORE INTO supplier (s_suppkey, s_name, s_nationkey) SELECT s_suppkey + 700000, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE concat(s_name, '!') END, s_nationkey FROM supplier")
    return e.sql("SELECT s_suppkey, s_name FROM supplier")


def ddl_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir)
    e.sql("CREATE DATABASE IF NOT EXISTS notes")
    e.sql("CREATE TABLE notes.memo (id BIGINT PRIMARY KEY, body TEXT)")
    e.sql("INSERT INTO notes.memo (id, body) VALUES (1, 'a'), (2, 'b')")
    return e.sql("SELECT id, body FROM notes.memo")


def transaction_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "supplier")
    for text in ("USE commerce", "BEGIN", "DELETE FROM supplier WHERE s_suppkey = 1", "TRUNCATE TABLE supplier", "COMMIT"):
        e.sql(text)
    return e.sql("SELECT count(*) AS n FROM supplier")


def show_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_for(spark, sf_dir, "supplier").sql("SHOW COLUMNS FROM commerce.supplier")


def dml_insert_unsharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "benchmark")
    e.sql("INSERT INTO benchmark (item_id, text) VALUES (900001, 'one more')")
    return e.sql("SELECT item_id, text FROM benchmark")


def dml_insert_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "region")
    e.sql("INSERT INTO region (r_regionkey, r_name) VALUES (77, 'NOWHERE')")
    return e.sql("SELECT r_regionkey, r_name FROM region")


def dml_lookup_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "supplier")
    e.sql("DELETE FROM supplier WHERE s_suppkey < 20")
    e.sql("UPDATE supplier SET s_nationkey = 99 WHERE s_suppkey = 30")
    return e.sql("SELECT s_nationkey, s_suppkey FROM nation_lookup")


def dml_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "customer", "orders")
    e.sql("INSERT INTO orders (o_orderkey, o_custkey, o_orderstatus) VALUES (90000001, 1, 'N'), (90000002, 2, 'N')")
    e.sql("UPDATE orders SET o_orderstatus = 'U' WHERE o_custkey IN (1, 4)")
    e.sql("DELETE FROM orders WHERE o_custkey = 7")
    return e.sql("SELECT c_custkey, o_orderstatus, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, o_orderstatus")


def dml_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "orders")
    e.sql("USE commerce")
    e.sql("TRUNCATE TABLE orders")
    return e.sql("SELECT count(*) AS n FROM orders")


def ddl_create_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "supplier")
    e.load("main.ticket_seq", spark.createDataFrame([(0, 500)], "id long, next_id long"))
    e.sql("CREATE TABLE commerce.ticket (id BIGINT UNSIGNED NOT NULL AUTO_INCREMENT, note VARCHAR(20), PRIMARY KEY (id))")
    e.sql("INSERT INTO ticket (note) VALUES ('a')")
    e.sql("ALTER TABLE commerce.ticket ADD COLUMN price DECIMAL(10,2)")
    e.sql("INSERT INTO ticket (id, note, price) VALUES (9, 'b', 1.25)")
    return e.sql("SELECT CAST(id AS BIGINT) AS id, note, price FROM ticket")


def ddl_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "CREATE TABLE a (id BIGINT, at DATETIME, doc JSON, raw BLOB)"
    return spark.createDataFrame([(d, translate(sql, "mysql", d)[0]) for d in ("mysql", "postgres", "mssql", "sqlite")], "dialect string, ddl string")


def reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "customer", "orders", "supplier")
    split(e, "commerce", 8)
    return e.sql("SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey")


def show_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_for(spark, sf_dir).sql("SHOW DATABASES")


def show_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_for(spark, sf_dir).sql("SHOW VARIABLES LIKE 'character_set_%'")


def show_vindexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_for(spark, sf_dir).sql("SHOW VSCHEMA VINDEXES")


def select_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_for(spark, sf_dir).sql("SELECT @@max_allowed_packet AS packet, @@session.autocommit AS auto, @@nothing AS nothing")


def event_windows_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = windowed(events, "ts", "2 hours", "10 minutes", ["event_type"], F.count(F.lit(1)).alias("n"), slide="1 hour")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def dml_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "customer", "orders")
    e.sql("DELETE FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
    e.sql("UPDATE orders SET o_orderpriority = 'none' WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 3)")
    return e.sql("SELECT o_orderkey, o_orderpriority FROM orders")


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "customer", "orders")
    e.sql("CREATE VIEW commerce.spending AS SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey")
    return e.sql("SELECT c_name, n, most FROM customer JOIN spending ON c_custkey = o_custkey WHERE n > 3")


def index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "lineitem")
    e.sql("CREATE INDEX by_date ON lineitem (l_shipdate)")
    return e.sql("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < TIMESTAMP '1993-01-01 00:00:00'")


def savepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scratch(spark, sf_dir, "supplier")
    for text in ("BEGIN", "DELETE FROM supplier WHERE s_suppkey < 10", "SAVEPOINT a", "DELETE FROM supplier", "ROLLBACK TO a", "COMMIT"):
        e.sql(text)
    return e.sql("SELECT s_suppkey FROM supplier")


FUNCTIONS = (
    dml_insert, dml_insert_select, dml_update, dml_delete, dml_lookup_update, transaction, sequence_fill, shard_counts, show_tables, vexplain, event_windows,
    vindex_null, vindex_multicol, vindex_static_map, lookup_rows, range_shards, use_shard, route_any_array, route_placeholders, limit_mysql, dml_insert_ignore,
    dml_insert_unsharded, dml_insert_reference, dml_lookup_delete, dml_bucketed, dml_truncate, ddl_create_alter, ddl_translated, reshard, show_databases,
    route_coerced_date, route_coerced_scale, route_coerced_argument, dml_delete_coerced, dml_insert_ignore_orders, dml_replace, dml_upsert, dml_upsert_lookup,
    ddl_if_not_exists, ddl_drop, ddl_alter_columns, ddl_unique_index, ddl_database, transaction_truncate, show_columns, show_variables, show_vindexes, select_variables, event_windows_sliding, dml_subquery, view, index_order, savepoint,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: sql_query(name) for name in SQL}
    out |= {f"vindex_{kind}": vindex_query(kind) for kind in VALUES}
    for f in FUNCTIONS:
        out[f.__name__] = f
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: text.replace("brand_part", "part") for name, (_, text) in SQL.items()}
    for kind, ids in GOLDEN.items():
        out[f"vindex_{kind}"] = "SELECT * FROM (VALUES " + ", ".join(f"('{v}', '{k}')" for v, k in zip(VALUES[kind], ids)) + ") t(v, ksid)"
    supplier = "SELECT s_suppkey, s_name, s_nationkey FROM supplier"
    out["dml_insert"] = supplier + " UNION ALL SELECT * FROM (VALUES (900001, 'new one', 3), (900002, 'new two', 4)) t"
    out["dml_insert_select"] = supplier + " UNION ALL SELECT s_suppkey + 500000, s_name, s_nationkey FROM supplier"
    out["dml_update"] = "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'moved' ELSE s_name END AS s_name, CAST(CASE WHEN s_acctbal > 0 THEN s_nationkey + 100 ELSE s_nationkey END AS INTEGER) AS s_nationkey FROM supplier"
    out["dml_delete"] = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'"
    out["dml_lookup_update"] = "SELECT c_custkey, 'renamed' AS c_name FROM customer WHERE c_custkey = 5"
    out["transaction"] = "SELECT s_suppkey FROM supplier WHERE s_suppkey >= 10"
    out["sequence_fill"] = "SELECT * FROM (VALUES (100::BIGINT, 'a'), (101, 'b'), (102, 'c'), (7, 'd')) t(id, note)"
    out["show_tables"] = "SELECT * FROM (VALUES ('customer'), ('orders'), ('lineitem'), ('supplier'), ('events'), ('nation'), ('region'), ('ticket')) t(Tables_in_commerce)"
    out["event_windows"] = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
    out["vindex_null"] = "SELECT * FROM (VALUES ('a', '0000000000000000'), ('1', '0000000000000000')) t(v, ksid)"
    out["vindex_multicol"] = "SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, '166b40b406e7ea22'), (4, 3, 'd2fd88674eb190c9')) t(a, b, ksid)"
    out["vindex_static_map"] = "SELECT * FROM (VALUES (1::BIGINT, '0000000000000064'), (7, '00000000000000ff'), (2, '06e7ea22ce92708f')) t(v, ksid)"
    out["lookup_rows"] = "SELECT s_nationkey, s_suppkey FROM supplier"
    out["range_shards"] = "SELECT CASE WHEN p_partkey < 1024 THEN '-0000000000000400' ELSE '0000000000000400-' END AS shard, count(*) AS n, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part GROUP BY 1"
    out["use_shard"] = "SELECT p_partkey, p_name FROM part WHERE p_partkey >= 1024"
    out["route_any_array"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 4, 7)"
    out["route_placeholders"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (11, 25) AND o_orderstatus <> 'F'"
    out["limit_mysql"] = "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25"
    out["dml_insert_ignore"] = supplier + " UNION ALL SELECT 900003, 'not yet', 4"
    out["dml_insert_unsharded"] = "SELECT item_id, text FROM benchmark UNION ALL SELECT 900001, 'one more'"
    out["dml_insert_reference"] = "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, 'NOWHERE'"
    out["dml_lookup_delete"] = "SELECT CAST(CASE WHEN s_suppkey = 30 THEN 99 ELSE s_nationkey END AS INTEGER) AS s_nationkey, s_suppkey FROM supplier WHERE s_suppkey >= 20"
    out["dml_bucketed"] = (
        "SELECT c_custkey, CASE WHEN o_custkey IN (1, 4) THEN 'U' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM customer "
        "JOIN (SELECT o_custkey, o_orderstatus FROM orders UNION ALL SELECT 1, 'N' UNION ALL SELECT 2, 'N') o ON c_custkey = o_custkey WHERE o_custkey <> 7 GROUP BY 1, 2"
    )
    out["dml_truncate"] = "SELECT 0::BIGINT AS n"
    out["ddl_create_alter"] = "SELECT * FROM (VALUES (500::BIGINT, 'a', NULL::DECIMAL(10,2)), (9, 'b', 1.25)) t(id, note, price)"
    out["reshard"] = "SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey"
    out["show_databases"] = 'SELECT * FROM (VALUES (\'commerce\'), (\'catalog\'), (\'brands\'), (\'days\'), (\'places\'), (\'main\')) t("Database")'
    out["show_variables"] = "SELECT 'character_set_' || k AS Variable_name, 'utf8mb4' AS \"Value\" FROM (VALUES ('client'), ('connection'), ('database'), ('results'), ('server')) t(k)"
    out["select_variables"] = "SELECT '67108864' AS packet, '1' AS auto, NULL::VARCHAR AS nothing"
    out["event_windows_sliding"] = "SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY 1, 2"
    out["dml_subquery"] = (
        "SELECT o_orderkey, CASE WHEN c_nationkey = 3 THEN 'none' ELSE o_orderpriority END AS o_orderpriority "
        "FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0"
    )
    out["view"] = "SELECT c_name, n, most FROM customer JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1) s ON c_custkey = o_custkey WHERE n > 3"
    out["index_order"] = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < TIMESTAMP '1993-01-01 00:00:00'"
    out["route_coerced_date"] = "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) IN (DATE '1995-01-05', DATE '1995-01-06')"
    out["route_coerced_scale"] = (
        "WITH p AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS DECIMAL(10,2)) AS price FROM orders) "
        "SELECT * FROM p WHERE price = (SELECT max(price) FROM p) OR price = 1000 OR price = 1234"
    )
    out["route_coerced_argument"] = "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7"
    out["dml_delete_coerced"] = "SELECT c_custkey, CASE WHEN c_custkey = 8 THEN 'none' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey <> 7"
    order = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"
    out["dml_insert_ignore_orders"] = f"{order} UNION ALL SELECT * FROM (VALUES (90000001, 1, 'N'), (90000002, 1, 'N')) t UNION ALL SELECT 1, 1, 'N' WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 1)"
    out["dml_replace"] = supplier + " WHERE s_suppkey <> 1 UNION ALL SELECT * FROM (VALUES (1, 'last', 5), (900004, 'new', 4)) t"
    out["dml_upsert"] = (
        "SELECT s_suppkey, CASE s_suppkey WHEN 2 THEN s_name || '/there' WHEN 3 THEN 'x' ELSE s_name END AS s_name, CAST(CASE WHEN s_suppkey = 2 THEN s_nationkey + 100 ELSE s_nationkey END AS INTEGER) AS s_nationkey "
        "FROM supplier UNION ALL SELECT 900005, 'new', 4"
    )
    out["dml_upsert_lookup"] = "SELECT s_suppkey, 77::INTEGER AS s_nationkey FROM supplier WHERE s_suppkey = 2"
    out["ddl_if_not_exists"] = "SELECT count(*) AS n FROM customer"
    out["ddl_drop"] = "SELECT 4::BIGINT AS s_suppkey, 1::INTEGER AS s_nationkey"
    out["ddl_alter_columns"] = "SELECT s_suppkey, s_name AS label, NULL::INTEGER AS note FROM supplier"
    out["ddl_unique_index"] = "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey + 700000, s_name || '!' FROM supplier WHERE s_suppkey % 2 <> 0"
    out["ddl_database"] = "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b')) t(id, body)"
    out["transaction_truncate"] = "SELECT 0::BIGINT AS n"
    out["shard_counts"] = "SELECT CASE WHEN md5(o_orderkey::VARCHAR) < '8' THEN '-80' ELSE '80-' END AS shard, count(*) AS n FROM orders GROUP BY 1"
    out["show_vindexes"] = (
        "SELECT Name AS \"Name\", Type AS \"Type\", u AS \"Unique\", c::INTEGER AS \"Cost\" FROM (VALUES ('binary', 'binary', true, 0), ('binary_md5', 'binary_md5', true, 1), ('by_kind', 'multicol', true, 1), "
        "('hash', 'hash', true, 1), ('name_lookup', 'lookup_unique', true, 10), ('nation_lookup', 'lookup_hash', false, 20), ('numeric', 'numeric', true, 0), ('order_lookup', 'consistent_lookup_unique', true, 10), "
        "('xxhash', 'xxhash', true, 1)) t(Name, Type, u, c)"
    )
    out["show_columns"] = (
        "SELECT f AS \"Field\", t AS \"Type\", 'YES' AS \"Null\", k AS \"Key\" FROM (VALUES ('s_suppkey', 'bigint', 'PRI'), ('s_name', 'string', ''), ('s_nationkey', 'int', ''), ('s_acctbal', 'double', '')) v(f, t, k)"
    )
    out["ddl_translated"] = (
        "SELECT * FROM (VALUES ('mysql', 'CREATE TABLE a ( id BIGINT , at DATETIME , doc JSON , raw BLOB )'), ('postgres', 'CREATE TABLE a (id BIGINT, at TIMESTAMP, doc JSONB, raw BYTEA)'), "
        "('mssql', 'CREATE TABLE a (id BIGINT, at DATETIME2, doc NVARCHAR(MAX), raw VARBINARY(MAX))'), ('sqlite', 'CREATE TABLE a (id INTEGER, at TEXT, doc TEXT, raw BLOB)')) t(dialect, ddl)"
    )
    out["savepoint"] = "SELECT s_suppkey FROM supplier WHERE s_suppkey >= 10"
    return out
