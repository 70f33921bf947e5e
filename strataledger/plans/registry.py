"""A register of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The ledger of strataledger.sources.txo in DuckDB's SQL.
TXO = """
WITH tx AS (
  SELECT o_orderkey AS tx_id, date_diff('day', timestamp '1995-01-01', o_orderdate) AS day_c, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) = 1 AS tx_coinbase FROM orders),
o AS (
  SELECT l.*, t.day_c, t.tx_coinbase, date_diff('day', timestamp '1995-01-01', l_shipdate) AS day_s,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS vout
  FROM lineitem l JOIN tx t ON l.l_orderkey = t.tx_id),
p AS (
  SELECT o.*, CASE WHEN l_partkey % 3 = 0 THEN (day_s - day_c) % 12 WHEN l_partkey % 3 = 1 THEN day_s - day_c ELSE (day_s - day_c) * 300 END AS life FROM o),
txo AS (
  SELECT l_orderkey AS tx_id, CAST(vout AS INT) AS vout, CAST(day_c * 300 AS INT) AS creation_block, CASE WHEN day_s >= day_c THEN CAST(day_c * 300 + life AS INT) END AS spent_block,
    CASE WHEN l_discount = 0.0 THEN CAST(0 AS BIGINT) ELSE CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 10 WHEN 3 THEN 100 WHEN 4 THEN 1000
      WHEN 5 THEN 10000 WHEN 6 THEN 100000 ELSE 1000000 END AS BIGINT) // 1000 END AS value,
    CAST(CASE l_partkey % 5 WHEN 0 THEN 25 WHEN 1 THEN 23 WHEN 2 THEN 35 WHEN 3 THEN 67 ELSE 141 END AS INT) AS locking_script_size,
    CASE WHEN day_s >= day_c THEN CAST(107 + l_suppkey % 40 AS INT) END AS unlocking_script_size, tx_coinbase, l_discount = 0.0 AS op_return, day_s >= day_c AS event,
    CASE WHEN day_s >= day_c THEN CAST(life AS INT) ELSE CAST(789999 - day_c * 300 AS INT) END AS duration
  FROM p)
"""

#: The same for SQL that goes on with recursive tables.
RECURSIVE = TXO.replace("WITH", "WITH RECURSIVE", 1)

#: An access log made of the events table.
ACCESS = """
WITH access AS (
  SELECT CAST(event_id AS INT) AS access_height, CAST(event_id - user_id * 3 + 100 AS INT) AS insertion_height, CAST(user_id % 5 AS INT) AS depth,
    user_id % 5 > 0 AND user_id % 2 = 0 AS is_cache_hit, event_type <> 'error' AS found, CASE WHEN event_type = 'view' THEN 'find' ELSE 'erase' END AS op
  FROM events)
"""


def register(name: str, sql: str | None = None, base: str = TXO) -> Callable[[Query], Query]:
    """Register a query; sql continues the WITH clause of base (start it with a comma to add to it)."""

    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = f"{base.rstrip()}{'' if sql.lstrip().startswith(',') else ' '}{sql.strip()}".strip()
        return query

    return add
