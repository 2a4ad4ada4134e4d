"""Marketplace: filters, counts, search, nearest listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithos.functions.numbers import canonical_unit, price_range
from lithos.operators.spatial import radius_pairs
from lithos.vocab import MATERIAL_GROUPS


def visible(listings: DataFrame) -> DataFrame:
    return listings.where("status <> 'verkauft'")


def filtered(listings: DataFrame, price: tuple = (None, None), available_from=None, materials=(), potentials=(), statuses=(), quantity=None, unit=None) -> DataFrame:
    """The filter panel: a listing needs a price; an object counts in pieces unless another unit is chosen, whether or not
    a quantity is asked for."""
    low, high = price_range(*(F.lit(None if x is None else float(x)).cast("double") for x in price))
    out = visible(listings).where(F.col("price").cast("double").between(low, high))
    if available_from is not None:
        out = out.where(F.col("available_from") <= F.lit(available_from).cast("date"))
    for name, values in (("material", materials), ("potential", potentials), ("status", statuses)):
        if values:
            out = out.where(F.col(name).isin(*values))
    wanted = F.coalesce(canonical_unit(F.lit(unit)), F.when(F.col("component_category") == "Objekt", F.lit("Stück")))
    out = out.where(wanted.isNull() | F.coalesce(canonical_unit(F.col("unit")) == wanted, F.lit(False)))
    return out if quantity is None else out.where(F.col("quantity") >= quantity)


def active_filters(filters: DataFrame) -> F.Column:
    """How many of the six groups are set; quantity and unit are one."""
    groups = [F.col("price_min").isNotNull() | F.col("price_max").isNotNull(), F.col("available_from").isNotNull(), F.size("materials") > 0, F.size("potentials") > 0, F.size("statuses") > 0, F.col("quantity").isNotNull()]
    return sum((F.coalesce(g, F.lit(False)).cast("int") for g in groups), F.lit(0))


def group_of(material) -> F.Column:
    """A material's group; null for those that have none."""
    return F.element_at(F.create_map(*[F.lit(x) for g, ms in MATERIAL_GROUPS.items() for m in ms for x in (m, g)]), material)


def category_counts(listings: DataFrame) -> DataFrame:
    """Listings per material group and object type."""
    kind = F.when(F.col("component_category") == "Objekt", F.struct(F.lit("object_type").alias("kind"), F.col("object_type").alias("value"))).otherwise(F.struct(F.lit("group").alias("kind"), group_of(F.col("material")).alias("value")))
    return listings.select(kind.alias("k")).where("k.value IS NOT NULL").groupBy("k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))


def deduped(listings: DataFrame) -> DataFrame:
    """One row per id, the last by creation, ties by the other columns."""
    last = W.partitionBy("id").orderBy(F.col("created_at").desc_nulls_last(), F.desc("price"), F.desc("quantity"), "owner_id")
    return listings.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def search(listings: DataFrame, query: str) -> DataFrame:
    """Listings whose name or material holds the trimmed query; an empty query finds nothing."""
    q = (query or "").strip().lower()
    if not q:
        return listings.where("false")
    return visible(listings.where(F.lower(F.concat_ws(" ", "name", "material", "object_type")).contains(q)))


def similar(listings: DataFrame, radius: float) -> DataFrame:
    """listings(id, kind, x, y): pairs of the same kind within the radius, with distance_m."""
    return radius_pairs(listings, radius, "id").where("kind = o_kind").select("id", F.col("o_id").alias("other"), F.round(F.sqrt("d2"), 6).alias("distance_m"))
