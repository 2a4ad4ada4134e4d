"""The conditions that stored rows must keep, by table, and what becomes of rows that break them.

A rule is a column that is false where a row breaks it; an unknown result breaks none, as with CHECK. A column that must
have a value has a rule of its own, so an unknown value of it is named once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.operators.structure import violations
from lithos.vocab import LISTING_UNITS, MATERIALS, OBJECT_TYPES, PART_TYPES

Rules = dict[str, F.Column]


def _present(*names: str) -> Rules:
    return {f"{k}_present": F.col(k).isNotNull() for k in names}


def _not_blank(*names: str) -> Rules:
    return {f"{k}_not_blank": F.btrim(k) != "" for k in names}


def _positive(*names: str) -> Rules:
    return {f"{k}_positive": F.col(k) > 0 for k in names}


def building_rules() -> Rules:
    return _present("building_id", "user_id", "structure", "name", "address") | _not_blank("building_id", "name")


def part_rules() -> Rules:
    """part_structure is struct<type, layers>; one without a type or without layers breaks its rule."""
    s = F.col("part_structure")
    given = s.isNull()  # a missing structure breaks part_structure_present alone
    return (
        _present("building_id", "user_building_id", "owner_id", "category", "name", "location", "part_type", "part_structure", "is_public", "is_hazardous")
        | _not_blank("building_id", "name", "location", "part_type")
        | {
            "category": F.col("category") == "Bauteil",
            "part_type": F.col("part_type").isin(*PART_TYPES),
            "structure_type": given | F.coalesce(s["type"].isin("wall", "slab"), F.lit(False)),
            "structure_layers": given | F.coalesce(F.size(s["layers"]) > 0, F.lit(False)),
        }
    )


def object_rules() -> Rules:
    return (
        _present("building_id", "user_building_id", "owner_id", "category", "name", "object_type", "count", "is_public", "is_hazardous")
        | _not_blank("building_id", "name", "object_type")
        | _positive("count", "length", "width", "height")
        | {"category": F.col("category") == "Objekt", "object_type": F.col("object_type").isin(*OBJECT_TYPES)}
    )


def market_rules() -> Rules:
    part, thing = F.col("component_category") == "Bauteil", F.col("component_category") == "Objekt"
    material, object_type = F.col("material").isNotNull(), F.col("object_type").isNotNull()
    return (
        _present("building_id", "owner_id", "user_building_id", "component_id", "component_category", "name", "address", "price", "status", "available_from", "potential", "quantity", "unit", "contact")
        | _not_blank("building_id", "name", "address", "contact", "location")
        | _positive("quantity", "length", "width", "height")
        | {
            "component_category": F.col("component_category").isin("Bauteil", "Objekt"),
            "price_not_negative": F.col("price") >= 0,
            "status": F.col("status").isin("eingelagert", "verbaut", "verkauft"),
            "potential": F.col("potential").isin("reuse", "recycle"),
            "unit": F.col("unit").isin(*LISTING_UNITS),
            "location_of_parts": thing | F.col("location").isNotNull(),
            "material_or_object": (part & material & ~object_type) | (thing & object_type & ~material),
            "material": F.col("material").isin(*MATERIALS),
            "object_type": F.col("object_type").isin(*OBJECT_TYPES),
        }
    )


def judged(rows: DataFrame, rules: Rules, name: str = "violations") -> DataFrame:
    """rows and the names of the rules that each breaks."""
    if name in rows.columns:
        raise ValueError(f"the rows have a column {name!r}; name another one for the violations")
    return rows.withColumn(name, violations(rules))


def accepted(rows: DataFrame, rules: Rules) -> DataFrame:
    """The rows that break no rule: one condition for each, so that those of one table are checked before rows are joined and
    no row has its list of violations made."""
    for ok in rules.values():
        rows = rows.where(F.coalesce(ok, F.lit(True)))
    return rows


def counted(rows: DataFrame, rules: Rules) -> DataFrame:
    """rule and n, the rows that break it; one pass, counted before anything is shuffled."""
    return rows.select(F.explode(violations(rules)).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that stand in more than one row, and in how many; as with UNIQUE, keys with a null part do not repeat."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    return rows.where(whole).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
