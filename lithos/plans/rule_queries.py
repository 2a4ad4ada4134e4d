"""Queries of the rules of stored rows. The derived rows break some rules now and then, by their number."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.operators import rules
from lithos.plans.views import view, with_views
from lithos.vocab import LISTING_UNITS, MATERIALS, OBJECT_TYPES, PART_TYPES

#: Columns of the derived rows, in SQL that Spark and DuckDB both run.
MARKET = {
    "id": "id",
    "building_id": "CASE WHEN id % 41 = 0 THEN '  ' ELSE CAST(building_id AS STRING) END",
    "owner_id": "owner_id",
    "user_building_id": "CASE WHEN id % 43 = 0 THEN NULL ELSE building_id END",
    "component_id": "id",
    "component_category": "CASE WHEN id % 47 = 0 THEN 'Anderes' WHEN id % 53 = 0 THEN NULL ELSE component_category END",
    "location": "CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN ' ' ELSE 'RG' END",
    "material": "CASE WHEN id % 61 = 0 THEN NULL ELSE material END",
    "object_type": "CASE WHEN object_type IS NULL THEN NULL WHEN id % 5 = 0 THEN 'Rohr' ELSE 'Rohre' END",
    "name": "CASE WHEN id % 13 = 0 THEN '  ' ELSE name END",
    "address": "CASE WHEN id % 59 = 0 THEN NULL ELSE 'Gasse 1' END",
    "price": "CASE WHEN id % 23 = 0 THEN -1 ELSE CAST(price AS DOUBLE) END",
    "status": "CASE WHEN id % 11 = 0 THEN 'weg' ELSE status END",
    "available_from": "available_from",
    "potential": "CASE WHEN id % 67 = 0 THEN 'hoch' WHEN potential = 'hoch' THEN 'reuse' ELSE 'recycle' END",
    "quantity": "CAST(quantity AS DOUBLE) - 1",
    "unit": "CASE unit WHEN 'kg' THEN 'Kilogramm' WHEN 'm3' THEN 'Kubikmeter' ELSE unit END",
    "contact": "CASE WHEN id % 71 = 0 THEN '' ELSE 'a@b' END",
    "length": "CASE WHEN id % 29 = 0 THEN 0 WHEN id % 2 = 0 THEN NULL ELSE 1.5 END",
    "width": "CASE WHEN id % 31 = 0 THEN -1 END",
    "height": "CASE WHEN id % 37 = 0 THEN -1 ELSE 2 END",
}
OBJECTS = {
    "building_id": MARKET["building_id"],
    "user_building_id": MARKET["user_building_id"],
    "owner_id": "owner_id",
    "category": "CASE WHEN id % 47 = 0 THEN 'Bauteil' ELSE 'Objekt' END",
    "name": MARKET["name"],
    "object_type": "CASE WHEN id % 7 = 0 THEN '' WHEN id % 11 = 0 THEN NULL ELSE 'Fenster' END",
    "count": "CAST(quantity AS INT) - 1",
    "length": MARKET["length"],
    "width": MARKET["width"],
    "height": MARKET["height"],
    "is_public": "CASE WHEN id % 17 = 0 THEN NULL ELSE TRUE END",
    "is_hazardous": "FALSE",
}
PARTS = {
    "building_id": "CASE WHEN build_id % 41 = 0 THEN '  ' ELSE CAST(build_id AS STRING) END",
    "user_building_id": "CASE WHEN build_id % 43 = 0 THEN NULL ELSE build_id END",
    "owner_id": "build_id",
    "category": "CASE WHEN build_id % 47 = 0 THEN 'Objekt' ELSE 'Bauteil' END",
    "name": "CASE WHEN build_id % 13 = 0 THEN '  ' ELSE 'Wand' END",
    "location": "CASE WHEN build_id % 37 = 0 THEN '' ELSE ort END",
    "part_type": "CASE WHEN build_id % 23 = 0 THEN 'Wand' WHEN art = 'AW' THEN 'Außenwand' WHEN art = 'IW' THEN 'Innenwand' WHEN art = 'FB' THEN 'Bodenaufbau' ELSE 'Dachaufbau' END",
    "is_public": "TRUE",
    "is_hazardous": "CASE WHEN build_id % 17 = 0 THEN NULL ELSE FALSE END",
    "s_type": "CASE WHEN build_id % 29 = 0 THEN 'roof' WHEN build_id % 53 = 0 THEN NULL WHEN art IN ('FB', 'D') THEN 'slab' ELSE 'wall' END",
}


def _rows(df, columns):
    return df.selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])


def _market(spark, d):
    return _rows(view(spark, d, "listings"), MARKET)


def q_market_rules(spark, d):
    return rules.counted(_market(spark, d), rules.market_rules())


def q_market_accepted(spark, d):
    return rules.accepted(_market(spark, d), rules.market_rules()).select("id", "owner_id", "material", "object_type", "price")


def q_object_rules(spark, d):
    return rules.counted(_rows(view(spark, d, "listings").where("component_category = 'Objekt'"), OBJECTS), rules.object_rules())


def q_part_rules(spark, d):
    layers = F.collect_list(F.when((F.col("build_id") % 31 != 0) | (F.col("pos") > 2), F.struct("pos", "material", "thickness")))
    by = view(spark, d, "layers").groupBy("build_id", "ort", "art").agg(layers.alias("layers"))
    exprs = [f"{v} AS {k}" for k, v in PARTS.items()]
    rows = by.selectExpr(*exprs, "layers", "build_id").select("*", F.when(F.col("build_id") % 59 != 0, F.struct(F.col("s_type").alias("type"), "layers")).alias("part_structure"))
    return rules.counted(rows, rules.part_rules())


def q_repeated(spark, d):
    """Buildings that a user has listed more than once under one key."""
    return rules.repeated(_market(spark, d).select("owner_id", "user_building_id"), "owner_id", "user_building_id")


QUERIES = {
    "market_rules": q_market_rules,
    "market_accepted": q_market_accepted,
    "object_rules": q_object_rules,
    "part_rules": q_part_rules,
    "repeated_keys": q_repeated,
}


def _in(column: str, values: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _checks(present: str, blank: str, positive: str, more: dict[str, str]) -> dict[str, str]:
    """Conditions of a table by rule, as its definition states them."""
    out = {f"{k}_present": f"{k} IS NOT NULL" for k in present.split()}
    out |= {f"{k}_not_blank": f"trim({k}, ' ') <> ''" for k in blank.split()}
    return out | {f"{k}_positive": f"{k} > 0" for k in positive.split()} | more


_MARKET_CHECKS = _checks(
    "building_id owner_id user_building_id component_id component_category name address price status available_from potential quantity unit contact",
    "building_id name address contact location",
    "quantity length width height",
    {
        "component_category": "component_category IN ('Bauteil', 'Objekt')",
        "price_not_negative": "price >= 0",
        "status": "status IN ('eingelagert', 'verbaut', 'verkauft')",
        "potential": "potential IN ('reuse', 'recycle')",
        "unit": _in("unit", LISTING_UNITS),
        "location_of_parts": "component_category = 'Objekt' OR location IS NOT NULL",
        "material_or_object": "(component_category = 'Bauteil' AND material IS NOT NULL AND object_type IS NULL) OR (component_category = 'Objekt' AND object_type IS NOT NULL AND material IS NULL)",
        "material": "material IS NULL OR " + _in("material", MATERIALS),
        "object_type": "object_type IS NULL OR " + _in("object_type", OBJECT_TYPES),
    },
)
_OBJECT_CHECKS = _checks(
    "building_id user_building_id owner_id category name object_type count is_public is_hazardous",
    "building_id name object_type",
    "count length width height",
    {"category": "category = 'Objekt'", "object_type": _in("object_type", OBJECT_TYPES)},
)
_PART_CHECKS = _checks(
    "building_id user_building_id owner_id category name location part_type part_structure is_public is_hazardous",
    "building_id name location part_type",
    "",
    {
        "category": "category = 'Bauteil'",
        "part_type": _in("part_type", PART_TYPES),
        "structure_type": "part_structure IS NULL OR coalesce(s_type IN ('wall', 'slab'), FALSE)",
        "structure_layers": "part_structure IS NULL OR n_layers > 0",
    },
)


def _counts(rows: str, checks: dict[str, str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (NOT ({v})) AS n FROM r" for k, v in checks.items())
    return f"WITH r AS MATERIALIZED ({rows}) SELECT rule, n FROM ({each}) WHERE n > 0"


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


_MARKET_ROWS = f"SELECT {_select(MARKET)} FROM listings"
_PART_ROWS = f"""SELECT {_select(PARTS)}, CASE WHEN build_id % 59 <> 0 THEN 1 END AS part_structure, n_layers
FROM (SELECT build_id, ort, art, count(*) FILTER (build_id % 31 <> 0 OR pos > 2) AS n_layers FROM layers GROUP BY ALL)"""
_ok = " AND ".join(f"coalesce({v}, TRUE)" for v in _MARKET_CHECKS.values())
ORACLES = {
    "market_rules": with_views(_counts(_MARKET_ROWS, _MARKET_CHECKS), "listings"),
    "market_accepted": with_views(f"WITH r AS ({_MARKET_ROWS}) SELECT id, owner_id, material, object_type, price FROM r WHERE {_ok}", "listings"),
    "object_rules": with_views(_counts(f"SELECT {_select(OBJECTS)} FROM listings WHERE component_category = 'Objekt'", _OBJECT_CHECKS), "listings"),
    "part_rules": with_views(_counts(_PART_ROWS, _PART_CHECKS), "layers"),
    "repeated_keys": with_views(f"WITH r AS ({_MARKET_ROWS}) SELECT owner_id, user_building_id, count(*) AS n FROM r WHERE user_building_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1", "listings"),
}
