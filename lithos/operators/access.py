"""Who sees and changes what, single lookups, unions of components, and checks of relations between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithos.operators.market import group_of


def can_read(owner: Column, is_public: Column, user) -> Column:
    """A component is open to its owner, and to all where it is public."""
    return F.coalesce(is_public, F.lit(False)) | F.coalesce(owner == F.lit(user), F.lit(False))


def owned(rows: DataFrame, user) -> DataFrame:
    """The rows that the user may change; nobody may change rows without an owner."""
    return rows.where(F.col("owner_id") == F.lit(user))


def by_one_filter(listings: DataFrame, group=None, material=None, object_type=None, owner=None) -> DataFrame:
    """Listings by exactly one of the filters; none or several are an error."""
    given = {k: v for k, v in {"group": group, "material": material, "object_type": object_type, "owner_id": owner}.items() if v is not None}
    if len(given) != 1:
        raise ValueError("exactly one filter is needed")
    ((name, value),) = given.items()
    return listings.where((group_of(F.col("material")) if name == "group" else F.col(name)) == F.lit(value))


def first_images(images: DataFrame, key: str = "listing_id") -> DataFrame:
    """The image with the smallest sort order of each listing, ties by address."""
    return images.groupBy(key).agg(F.min(F.struct("sort_order", "image_url")).alias("i")).select(key, F.col("i.image_url").alias("image_url"))


def component_options(parts: DataFrame, objects: DataFrame) -> DataFrame:
    """Parts and objects with their kind, by name without regard to case and accents; rows without an id are left out."""
    both = parts.select(F.lit("part").alias("kind"), "id", "name").unionByName(objects.select(F.lit("object").alias("kind"), "id", "name"))
    return both.where("id IS NOT NULL").orderBy(F.collate("name", "de_CI_AI"), "kind", "id")


def document_summaries(documents: DataFrame, building, component=None) -> DataFrame:
    """Documents of a building, of one component if it is given; the flag may come under either of two names."""
    out = documents.where(F.col("building_id") == F.lit(building))
    if component is not None:
        out = out.where(F.col("component_id") == F.lit(component))
    return out.withColumn("readable", F.coalesce("can_read", "canRead", F.lit(False)))


def latest_structure(buildings: DataFrame) -> DataFrame:
    """The row of each building whose structure was changed last, ties by id; rows without a time come last."""
    order = W.partitionBy("building_id").orderBy(F.col("structure_updated_at").desc_nulls_last(), F.col("id"))
    return buildings.withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row")


def seed(rows: DataFrame, buildings: DataFrame) -> DataFrame:
    """Rows of parts or objects whose owner has the building, with the id of that user's building."""
    return rows.join(buildings.select("building_id", F.col("user_id").alias("owner_id"), F.col("id").alias("user_building_id")), ["building_id", "owner_id"])


def with_address(listings: DataFrame, buildings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings with the address of the owner's building, those that have none): three keys must agree and the address
    must not be blank."""
    at = buildings.select("building_id", F.col("user_id").alias("owner_id"), F.col("id").alias("user_building_id"), "address")
    found = listings.join(at, ["building_id", "owner_id", "user_building_id"], "left")
    good = F.coalesce(F.btrim("address") != "", F.lit(False))
    return found.where(good), found.where(~good).drop("address")


def survivors(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there; children without a parent stay."""
    gone = children.where(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_semi")
    return gone.unionByName(children.where(F.col(key).isNull()).select(*gone.columns))


def orphans(rows: DataFrame, reference: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(keys of rows that the reference lacks, keys that rows have more than once): both must be empty."""
    return rows.select(key).join(reference.select(key), key, "left_anti").distinct(), rows.groupBy(key).count().where("count > 1")


def schema_difference(have: DataFrame, want: DataFrame) -> DataFrame:
    """Columns (table, column, type) of one schema description that the other lacks, both ways."""
    cols = ["table", "column", "type"]
    a, b = have.select(*cols), want.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("surplus")).unionByName(b.exceptAll(a).withColumn("side", F.lit("missing")))
