"""Build-up strings such as '(Putz, 0.015; Ziegel, 0.16)' and layer arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _fields(mat: Column) -> Column:
    bare = F.btrim(F.trim(mat), F.lit("()"))
    return F.transform(F.split(bare, ";"), lambda lay: F.transform(F.split(lay, ","), lambda p: F.trim(p)))


def parse_materials(mat: Column) -> Column:
    """Material names in order; beam lines (an 'x' after the name) are skipped, layers without thickness stay."""
    kept = F.filter(_fields(mat), lambda p: (F.get(p, F.lit(0)) != "") & ~F.exists(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: x.contains("x")))
    return F.transform(kept, lambda p: F.get(p, F.lit(0)))


def parse_layers(mat: Column) -> Column:
    """(material, thickness) of the layers that have a number: the first field after the name that is one."""
    numbers = lambda p: F.filter(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: x.rlike(NUMBER))
    kept = F.filter(_fields(mat), lambda p: (F.get(p, F.lit(0)) != "") & (F.size(numbers(p)) > 0))
    return F.transform(kept, lambda p: F.struct(F.get(p, F.lit(0)).alias("material"), F.get(numbers(p), F.lit(0)).try_cast("double").alias("thickness")))


def total_thickness(layers: Column, ignored: list[str]) -> Column:
    """Sum of the thicknesses; layers of the ignored materials and nulls count 0."""
    return F.aggregate(layers, F.lit(0.0), lambda s, x: s + F.when(x["material"].isin(*ignored), F.lit(0.0)).otherwise(F.coalesce(x["thickness"], F.lit(0.0))))


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def reindexed(layers: Column, connections: list[str]) -> Column:
    """Layers numbered from 1, thickness rounded and not below 0; connections have none."""
    return F.transform(layers, lambda x, i: F.struct((i + 1).alias("layer_index"), x["material"].alias("material"), F.when(x["material"].isin(*connections), F.lit(0)).otherwise(F.greatest(F.lit(0), js_round(F.coalesce(x["thickness"], F.lit(0.0))))).cast("long").alias("thickness")))
