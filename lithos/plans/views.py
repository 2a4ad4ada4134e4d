"""Domain tables derived from the driver's generic tables, in SQL that Spark and DuckDB both run.

The operators take any table with the columns named here; these views only give them data that grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.session import parts, read_table

PERIOD = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'bis 1918' WHEN '2' THEN '1919-1944' WHEN '3' THEN '1945-1979' WHEN '4' THEN '1980-1999' ELSE 'ab 2000' END"
ORT = "CASE o_orderstatus WHEN 'F' THEN 'KG' WHEN 'O' THEN 'RG' ELSE 'DG' END"
ART = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AW' WHEN 'BUILDING' THEN 'IW' WHEN 'FURNITURE' THEN 'FB' WHEN 'HOUSEHOLD' THEN 'D' ELSE 'AW' END"
MATERIAL = "CASE p_type WHEN 'MEDIUM' THEN 'Ziegel' WHEN 'STANDARD' THEN 'Putz' WHEN 'LARGE' THEN 'STB' WHEN 'PROMO' THEN 'Holz' WHEN 'SMALL' THEN 'Styropor' ELSE 'Estrich' END"

#: Rows that one task takes: buildings carry much work each, order lines are sorted in memory.
BUILDINGS_A_TASK, LINES_A_TASK = 5_000, 250_000

#: The order of an order's lines, as the layers view states it.
PLACE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]

VIEWS = {
    # one row per layer of a catalog build-up, in order; all of its layers
    "layers": f"""
SELECT o_orderkey AS build_id, {PERIOD} AS bauperiode, {ORT} AS ort, {ART} AS art, o_totalprice / 1000 AS nettoflaeche,
       CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS INT) AS pos,
       {MATERIAL} AS material, l_quantity / 100 AS thickness
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
    "buildings": """
SELECT c_custkey AS bw_geb_id,
       CASE c_custkey % 7 WHEN 0 THEN '0' WHEN 1 THEN '0,1' WHEN 2 THEN '0,2' WHEN 3 THEN '0,1,2' WHEN 4 THEN '2,4' WHEN 5 THEN '5' ELSE '3,4' END AS bp,
       CAST(c_nationkey % 4 + 1 AS INT) AS dom_nutzung, CAST(c_nationkey % 6 AS INT) AS bp_best_guess,
       abs(c_acctbal) / 400 + 3 AS maxhoehe, abs(c_acctbal) * 3 AS m3vol, abs(c_acctbal) AS m2bgf,
       CAST((c_custkey % 100) * 12 AS DOUBLE) AS x0, CAST(floor(c_custkey / 100) * 10 AS DOUBLE) AS y0,
       CAST(CASE WHEN c_custkey % 3 = 0 THEN 12 ELSE 10 END AS DOUBLE) AS wx, CAST(10 AS DOUBLE) AS wy
FROM customer""",
    "listings": f"""
SELECT l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 AS id, l_suppkey AS owner_id, o_custkey AS building_id,
       CASE WHEN l_partkey % 4 = 0 THEN 'Objekt' ELSE 'Bauteil' END AS component_category,
       CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE {MATERIAL} END AS material,
       CASE WHEN l_partkey % 4 = 0 THEN p_brand END AS object_type, p_name AS name,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_quantity AS DECIMAL(14,3)) AS quantity,
       CASE l_suppkey % 4 WHEN 0 THEN 'Stueck' WHEN 1 THEN 'kg' WHEN 2 THEN 'm3' ELSE 'Stück' END AS unit,
       CASE l_returnflag WHEN 'A' THEN 'verbaut' WHEN 'N' THEN 'eingelagert' ELSE 'verkauft' END AS status,
       CASE l_linestatus WHEN 'O' THEN 'hoch' ELSE 'niedrig' END AS potential,
       CAST(l_shipdate AS DATE) AS available_from, o_orderdate AS created_at, l_shipdate AS shipped
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "jobs": """
SELECT event_id, ts, user_id AS job_id, value,
       CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'error' END AS status
FROM events""",
    "points": """
SELECT l_suppkey % 8 AS scan_id, CAST(l_orderkey % 500 AS DOUBLE) / 50 AS x, CAST(l_partkey % 400 AS DOUBLE) / 50 AS y, l_extendedprice / 10000 AS z FROM lineitem""",
    "segments": """
SELECT l_orderkey % 200 AS plan_id, l_orderkey AS seg_id, l_linenumber AS no, CAST(l_partkey % 50 AS DOUBLE) AS x1, CAST(l_suppkey % 50 AS DOUBLE) AS y1,
       CAST(l_partkey % 50 AS DOUBLE) + l_quantity AS x2, CAST(l_suppkey % 50 AS DOUBLE) AS y2, l_quantity * 10 AS length_mm, l_discount + 0.1 AS thickness_m,
       CAST(l_suppkey % 6 AS INT) AS group_id, l_returnflag AS part_type
FROM lineitem""",
}
TABLES = {"layers": ("lineitem", "orders", "customer", "part"), "buildings": ("customer",), "listings": ("lineitem", "orders", "part"), "jobs": ("events",), "points": ("lineitem",), "segments": ("lineitem",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; the tables are bound by value, so no temporary view is registered."""
    if name == "layers":
        return _layers(spark, sf_dir)
    sql = VIEWS[name]
    for t in TABLES[name]:
        sql = sql.replace(f"FROM {t}\n", f"FROM {{{t}}}\n").replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        if sql.endswith(f"FROM {t}"):
            sql = sql[: -len(t)] + f"{{{t}}}"
    tables = {t: read_table(spark, sf_dir, t) for t in TABLES[name]}
    if name == "buildings":
        c = tables["customer"].select("c_custkey", "c_nationkey", "c_acctbal")
        tables["customer"] = c.repartition(parts(c, BUILDINGS_A_TASK), "c_custkey")
    return spark.sql(sql, **tables)


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers view with the same expressions, joined so that order lines are shuffled by part and by order only, the
    latter into tasks of a bounded number of lines."""
    lineitem, orders, customer, part = (read_table(spark, sf_dir, t) for t in TABLES["layers"])
    kinds = customer.selectExpr("c_custkey", f"{ART} AS art")
    build = orders.join(kinds, F.col("o_custkey") == F.col("c_custkey")).selectExpr("o_orderkey", f"{PERIOD} AS bauperiode", f"{ORT} AS ort", "art", "o_totalprice / 1000 AS nettoflaeche")
    made = part.selectExpr("p_partkey", f"{MATERIAL} AS material")
    line = lineitem.join(made, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", *PLACE, "material")
    n = parts(lineitem, LINES_A_TASK)
    rows = line.repartition(n, "l_orderkey").join(build.repartition(n, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    pos = f"CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY {', '.join(PLACE)}) AS INT) AS pos"
    return rows.selectExpr("o_orderkey AS build_id", "bauperiode", "ort", "art", "nettoflaeche", pos, "material", "l_quantity / 100 AS thickness")


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that has the views as common table expressions."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
