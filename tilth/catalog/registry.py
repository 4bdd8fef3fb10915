"""Registered queries: a Spark callable and, where one can be written, its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
INVENTORY: dict[str, str] = {}

PARCELS = """
parcels AS (
 SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
  r.r_name AS region, c.c_mktsegment AS soil_type, p.p_type AS crop, l.l_returnflag AS weather,
  (l.l_linestatus = 'F') AS fertilizer_used, (l.l_discount > 0.05) AS irrigation_used,
  CAST(100 + l.l_extendedprice * 0.0085 AS DOUBLE) AS rainfall_mm,
  CAST(15 + p.p_size * 0.5 AS DOUBLE) AS temperature_c,
  CAST(60 + l.l_quantity AS INT) AS days_to_harvest,
  CAST(round(l.l_extendedprice * 100) AS BIGINT) AS price_cents,
  CAST(-1.0 + 0.005 * (100 + l.l_extendedprice * 0.0085) + CASE WHEN l.l_linestatus = 'F' THEN 1.5 ELSE 0.0 END
   + CASE WHEN l.l_discount > 0.05 THEN 1.2 ELSE 0.0 END + 0.02 * p.p_size
   + (CAST(round(l.l_extendedprice * 100) AS BIGINT) % 1000) / 500.0 - 1.0 AS DOUBLE) AS yield_t
 FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey)
"""

CLEAN = PARCELS + ", clean AS (SELECT * FROM parcels WHERE yield_t >= 0)\n"

PANEL = """
ship AS (
 SELECT l.*, n.n_nationkey, n.n_name AS area, CAST(year(l.l_shipdate) AS INT) AS yr
 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey),
yield_raw AS (
 SELECT area, p.p_type AS item, yr, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/100 AS hg_ha_yield
 FROM ship JOIN part p ON l_partkey = p.p_partkey GROUP BY area, p.p_type, yr),
rain_raw AS (
 SELECT DISTINCT area, yr, CASE WHEN (n_nationkey + yr) % 7 = 0 THEN '..'
  ELSE CAST(500 + 20*n_nationkey + (yr % 5) AS VARCHAR) END AS rain_mm FROM ship),
pest_raw AS (
 SELECT area, yr, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS pesticides_t FROM ship WHERE yr >= 1997 GROUP BY area, yr),
temp_raw AS (
 SELECT area AS country, yr, CAST(10 + (l_linenumber % 3) + n_nationkey * 0.5 AS DOUBLE) AS avg_temp FROM ship WHERE yr <= 2000),
panel AS (
 SELECT y.area, y.item, y.yr, y.hg_ha_yield, TRY_CAST(r.rain_mm AS DOUBLE) AS rain_mm, q.pesticides_t, t.avg_temp
 FROM yield_raw y JOIN rain_raw r ON y.area = r.area AND y.yr = r.yr JOIN pest_raw q ON y.area = q.area AND y.yr = q.yr
  JOIN (SELECT DISTINCT * FROM temp_raw) t ON y.area = t.country AND y.yr = t.yr
 WHERE TRY_CAST(r.rain_mm AS DOUBLE) IS NOT NULL)
"""

CROP_MAP = """
crop_map AS (
 SELECT * FROM (VALUES ('STANDARD','STANDARD'),('SMALL','SMALL'),('LARGE','LARGE'),('PROMO','PROMO'),
  ('ECONOMY',NULL),('MEDIUM',NULL)) t(crop, item))
"""


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under its name with the inventory entries it covers."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        INVENTORY[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
