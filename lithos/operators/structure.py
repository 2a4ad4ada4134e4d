"""Buildings, parts and objects as stored: rules, labels, imports, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def violations(rules: dict[str, F.Column]) -> F.Column:
    """Names of the rules that a row breaks; an unknown result does not break a rule, as with CHECK."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())


def listing_rules() -> dict[str, F.Column]:
    part = F.col("component_category") == "Bauteil"
    return {
        "price": F.col("price") >= 0,
        "quantity": F.col("quantity") > 0,
        "status": F.col("status").isin("verbaut", "eingelagert", "verkauft"),
        "name": F.btrim("name") != "",
        "material_or_object": F.when(part, F.col("material").isNotNull() & F.col("object_type").isNull()).otherwise(F.col("material").isNull() & F.col("object_type").isNotNull()),
    }


def valid_storeys(structure: F.Column) -> F.Column:
    """A roof with a type, at least one regular storey, and counts, heights and areas that are positive."""
    roof = F.exists(structure, lambda s: (s["type"] == "Dach") & s["roofType"].isNotNull())
    regular = F.exists(structure, lambda s: s["type"] == "RG")
    sound = F.forall(structure, lambda s: (s["type"] == "Dach") | (F.coalesce(s["count"] > 0, F.lit(False)) & F.coalesce(s["height"] > 0, F.lit(False)) & F.coalesce(s["area"] > 0, F.lit(False))))
    return F.coalesce(roof & regular & sound, F.lit(False))


def valid_part(measure: F.Column, layers: F.Column, connections: list[str]) -> F.Column:
    """Measure of 1 or more, every layer with a material, at least one with thickness, none below 1; connections count as 0."""
    t = F.transform(layers, lambda x: F.when(x["material"].isin(*connections), F.lit(0.0)).otherwise(F.coalesce(x["thickness"], F.lit(0.0))))
    named = F.forall(layers, lambda x: F.coalesce(x["material"] != "", F.lit(False)))
    return F.coalesce((measure >= 1) & named & F.exists(t, lambda x: x > 0) & F.forall(layers, lambda x: x["material"].isin(*connections) | (F.coalesce(x["thickness"], F.lit(0.0)) >= 1)), F.lit(False))


#: Part types that a location allows, by floor or roof.
ALLOWED = {"pitched": ["KS", "BA", "DA"], "flat": ["A", "DA"], "none": ["DA"], "RG": ["IW", "AW", "BW", "BA"], "KG": ["IW", "AW", "BW", "BA"]}


def allowed_types(locations: F.Column) -> F.Column:
    """Part types that all chosen locations allow; none without a location."""
    by = F.create_map(*[x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    sets = F.transform(locations, lambda x: F.coalesce(F.element_at(by, x), F.array().cast("array<string>")))
    return F.when(F.size(locations) == 0, F.array().cast("array<string>")).otherwise(F.aggregate(F.slice(sets, 2, 100), F.get(sets, F.lit(0)), lambda a, b: F.array_intersect(a, b)))


def storey_summary(s: F.Column) -> F.Column:
    """'(3x, 270 cm, 260 m²)'; zero and missing figures are left out."""
    shown = lambda v, fmt: F.when(v > 0, F.concat(*fmt(v.cast("string"))))
    parts = F.array(shown(s["count"], lambda x: (x, F.lit("x"))), shown(s["height"], lambda x: (x, F.lit(" cm"))), shown(s["area"], lambda x: (x, F.lit(" m²"))))
    text = F.array_join(F.filter(parts, lambda x: x.isNotNull()), ", ")
    return F.when(text == "", "").otherwise(F.concat(F.lit("("), text, F.lit(")")))


def storey_labels(storeys: DataFrame) -> DataFrame:
    """storeys(building_id, pos, type): 'RG 2' per type in order, a roof keeps its type."""
    n = F.row_number().over(W.partitionBy("building_id", "type").orderBy("pos"))
    return storeys.withColumn("label", F.when(F.col("type") == "Dach", F.col("type")).otherwise(F.concat_ws(" ", "type", n.cast("string"))))


def reallocate(stored: DataFrame, arriving: DataFrame, key: str = "source_extract_id") -> tuple[DataFrame, DataFrame]:
    """(rows after the import, counters per extract): rows of an extract that arrives again are replaced as a whole; rows
    without an extract stay."""
    again = arriving.select(key).where(F.col(key).isNotNull()).distinct()
    kept = stored.join(again, key, "left_anti")
    deleted = stored.join(again, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("deleted"))
    inserted = arriving.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("inserted"))
    counts = inserted.join(deleted, key, "left").select(key, F.coalesce("deleted", F.lit(0)).alias("deleted"), "inserted")
    return kept.unionByName(arriving), counts


def merge_updates(old: DataFrame, new: DataFrame, key: str, columns: list[str], now: F.Column) -> DataFrame:
    """Upsert by key: updated_at moves only where a column is distinct from before; a new row has it from the start.

    All columns of old stay, also those that are not merged (null in new rows). Null keys equal one another, so merging
    the same rows again adds none.
    """
    n = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    j = old.withColumn("_old", F.lit(True)).join(n, F.col(key).eqNullSafe(F.col("_key")), "full")
    take, known = F.coalesce("_new", F.lit(False)), F.coalesce("_old", F.lit(False))
    changed = take & ~(known & _all([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]))
    out = {c: F.when(take, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns} | {key: F.when(known, F.col(key)).otherwise(F.col("_key")), "updated_at": F.when(changed, now).otherwise(F.col("updated_at"))}
    return j.select(*[out.get(c, F.col(c)).alias(c) for c in old.columns])


def _all(conditions: list) -> F.Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def reserved(open_rows: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """Upload reservations: an open one with the same key keeps its id, else a new one is derived from the key.

    The new id also hashes how many rows of the key have their file, so that each reservation after a file has another;
    two that are asked for at once have the same. Key parts are hashed as JSON, which keeps them apart; nulls are equal.
    """
    mine = open_rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min(F.when(F.col("file_url").isNull(), F.col("id"))).alias("old_id"), F.count("file_url").alias("_attached"))
    same = _all([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    new_id = F.sha2(F.to_json(F.array(*[F.col(k).cast("string") for k in key], F.coalesce("_attached", F.lit(0)).cast("string"))), 256)
    return asked.join(mine, same, "left").withColumn("id", F.coalesce("old_id", new_id)).select(*asked.columns, "id")
