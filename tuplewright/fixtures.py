"""Graphs, tuples, logs and keyed entries derived from the star-schema tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

EDGES = """
SELECT CAST(o_custkey AS BIGINT) AS src, CAST(10000000 + l_partkey AS BIGINT) AS dst FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
UNION SELECT CAST(10000000 + l_partkey AS BIGINT), CAST(20000000 + l_suppkey AS BIGINT) FROM {lineitem}
UNION SELECT CAST(20000000 + s_suppkey AS BIGINT), CAST(30000000 + s_nationkey AS BIGINT) FROM {supplier}
UNION SELECT CAST(30000000 + n_nationkey AS BIGINT), CAST(40000000 + n_regionkey AS BIGINT) FROM {nation}
"""

#: New edges: some are there already.
NEW_EDGES = "SELECT DISTINCT CAST(o_custkey AS BIGINT) AS src, CAST(10000000 + o_orderkey AS BIGINT) AS dst FROM {orders}"

#: Customers live in territories, which may lie in larger ones; catalogs nest, are open to an audience and have stewards;
#: an order is its buyer's and is listed in a catalog.
TUPLES = """
SELECT 'territory' AS object_type, 'r' || CAST(n_regionkey AS STRING) AS object_id, 'resident' AS relation, 'territory' AS subject_type, 'n' || CAST(n_nationkey AS STRING) AS subject_id, 'resident' AS subject_relation FROM {nation}
UNION ALL SELECT 'territory', 'n' || CAST(c_nationkey AS STRING), 'resident', 'customer', 'c' || CAST(c_custkey AS STRING), '' FROM {customer}
UNION ALL SELECT 'catalog', 'p' || CAST(p_partkey AS STRING), 'within', 'catalog', 'p' || CAST(CAST(floor((p_partkey - 1) / 2) AS BIGINT) AS STRING), '' FROM {part} WHERE p_partkey > 0
UNION ALL SELECT 'catalog', 'p' || CAST(p_partkey AS STRING), 'steward', 'customer', 'c' || CAST(p_partkey % (SELECT count(*) FROM {customer}) AS STRING), '' FROM {part} WHERE p_size = 7
UNION ALL SELECT 'catalog', 'p' || CAST(s_suppkey AS STRING), 'audience', 'territory', CASE WHEN s_suppkey % 10 = 0 THEN 'r' || CAST(s_nationkey % 5 AS STRING) ELSE 'n' || CAST(s_nationkey AS STRING) END, 'resident' FROM {supplier} WHERE s_suppkey > 0
UNION ALL SELECT 'order', 'o' || CAST(o_orderkey AS STRING), 'listed', 'catalog', 'p' || CAST(o_orderkey % (SELECT count(*) FROM {part}) AS STRING), '' FROM {orders}
UNION ALL SELECT 'order', 'o' || CAST(o_orderkey AS STRING), 'buyer', 'customer', 'c' || CAST(o_custkey AS STRING), '' FROM {orders}
"""

#: TUPLES with a cycle of territories and one of catalogs.
CYCLIC = (
    TUPLES
    + """UNION ALL SELECT 'territory', 'n0', 'resident', 'territory', 'r0', 'resident'
UNION ALL SELECT 'catalog', 'p0', 'within', 'catalog', 'p' || CAST((SELECT count(*) FROM {part}) - 1 AS STRING), ''
"""
)

MODEL = """
schema 1
type customer
type territory { relation resident: customer | territory#resident }
type catalog {
  relation within: catalog
  relation steward: customer
  relation audience: customer | territory#resident
  permission browse = audience + steward + within->browse
}
type order {
  relation buyer: customer
  relation listed: catalog
  permission track = buyer + listed->browse
}
"""

LOG = """
SELECT CAST(event_id + 1 AS BIGINT) AS lsn, CAST(ts AS TIMESTAMP) AS commit_ts, CAST(floor((event_id + 4) / 4) * 4 AS BIGINT) AS txn_lsn,
       CAST(1 + floor(event_id / 2500) AS BIGINT) AS epoch, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS event,
       'group' AS object_type, 'g' || CAST(CAST(floor(value) AS BIGINT) % 20 AS STRING) AS object_id, 'member' AS relation,
       'user' AS subject_type, 'u' || CAST(user_id AS STRING) AS subject_id, '' AS subject_relation, 1 AS schema_version, '' AS detail
FROM {events} WHERE event_type <> 'click'
"""

#: The same before decoding: names whole, commits as records of their own kind.
RECORDS = """
SELECT CAST(event_id + 1 AS BIGINT) AS lsn, CASE WHEN event_type = 'click' THEN 'commit' ELSE 'data' END AS kind,
       CASE WHEN event_type = 'error' THEN 'remove' WHEN event_type = 'signup' THEN 'schema' ELSE 'add' END AS event,
       CASE WHEN event_type = 'signup' THEN CAST(event_id AS INT) END AS version,
       CASE WHEN event_type = 'signup' THEN 'loose' ELSE 'group:g' || CAST(CAST(floor(value) AS BIGINT) % 20 AS STRING) || ':x' END AS object,
       'member' AS relation, 'user:u' || CAST(user_id AS STRING) AS subject, CAST(NULL AS STRING) AS subject_relation, CAST(NULL AS STRING) AS detail
FROM {events}
"""

TENURES = "SELECT DISTINCT CAST(1 + floor(event_id / 2500) AS BIGINT) AS epoch, CAST(1 + floor(event_id / 2500) * 2500 AS BIGINT) AS first_lsn FROM {events}"

OPERATIONS = """
SELECT CAST(floor(event_id / 1000) AS INT) AS entry, CAST(user_id AS BIGINT) AS key_hash, CAST(event_id + 1 AS BIGINT) AS seq,
       CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS kind, CAST(floor(value) AS BIGINT) AS amount, value AS score, event_type AS label
FROM {events}
"""

RIDES = "SELECT CAST(l_suppkey % 3 AS INT) AS vendor_id, l_extendedprice AS total_amount, l_quantity AS trip_distance, CAST(l_linenumber AS INT) AS payment_type, l_returnflag AS flag FROM {lineitem}"

_TABLE = re.compile(r"\{(\w+)\}")


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(_TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))


def oracle(**relations: str) -> str:
    """The relations as common tables, for a statement that goes on with a comma or SELECT."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_TABLE.sub(lambda m: m[1], sql)})" for n, sql in relations.items())
