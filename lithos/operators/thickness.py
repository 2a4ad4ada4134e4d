"""Layer-thickness models A to D over layer rows (build_id, cell, nettoflaeche, pos, material, thickness)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithos.operators.backoff import backoff, leveled
from lithos.operators.markov import CELL
from lithos.session import stored
from lithos.vocab import FIXED_LAYER_M


def observations(layers: DataFrame) -> DataFrame:
    """Per level and material: weighted mean thickness t and number of observations n."""
    w = F.greatest(F.coalesce("nettoflaeche", F.lit(0.0)), F.lit(0.0)) + 0.01
    cell = layers.groupBy(*CELL, "material").agg(F.sum(F.col("thickness") * w).alias("tw"), F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"))
    by = leveled(cell, CELL).groupBy("level", "key", "material").agg(F.sum("tw").alias("tw"), F.sum("w").alias("w"), F.sum("n").alias("n"))
    return by.select("level", "key", "material", (F.col("tw") / F.col("w")).alias("t"), "n")


def mean_thickness(asked: DataFrame, layers: DataFrame) -> DataFrame:
    """asked(cell, material) with level and mean: the first level with two observations, else the global one."""
    enough = (F.col("n") >= 2) | (F.col("level") == 3)
    return backoff(asked.select(*CELL, "material").distinct(), observations(layers), CELL, ["material"], enough)


def medians(layers: DataFrame) -> DataFrame:
    """Per material: exact median, and whether it is a fixed cover layer."""
    return layers.groupBy("material").agg(F.median("thickness").alias("median_t")).withColumn("fixed", F.col("median_t") < FIXED_LAYER_M)


def _builds(layers: DataFrame) -> DataFrame:
    """Build-ups put together and written once, a row each for its cell, with seq and the cell's layers as items."""
    item = F.struct("pos", "material", "nettoflaeche", "thickness", F.struct(*CELL).alias("cell"))
    by = layers.where("build_id IS NOT NULL").groupBy("build_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    seq = F.concat_ws(";", F.transform("items", lambda x: x["material"]))
    # a build-up is of one cell, as a rule
    by = by.select("build_id", seq.alias("seq"), "items", F.explode(F.array_distinct(F.transform("items", lambda x: x["cell"]))).alias("c"))
    own = F.filter("items", lambda x: x["cell"].eqNullSafe(F.col("c")))
    return stored(by.select("build_id", "c.*", "seq", F.transform(own, lambda x: x.dropFields("cell")).alias("items")))


def _left_out(builds: DataFrame) -> DataFrame:
    """Every layer of the build-ups with level and seq_mean, null where no level suffices.

    Build-ups are dealt by their sequence, which all levels share, so the totals of all levels are made in one task, and
    totals go back to build-ups by cell and sequence, not layer by layer.
    """
    w = F.greatest(F.coalesce("nettoflaeche", F.lit(0.0)), F.lit(0.0)) + 0.01
    rows = builds.select(*CELL, "seq", "items").repartition("seq").select(*CELL, "seq", F.inline("items"))
    cell = rows.groupBy(*CELL, "seq", "pos").agg(F.sum(F.col("thickness") * w).alias("stw"), F.sum(w).alias("sw"), F.count(F.lit(1)).alias("n"))
    # the level is that of a cell's sequence, so it is looked up once for all build-ups that say the same
    found = backoff(cell, ["stw", "sw", "n"], CELL, ["seq", "pos"], lambda x: x["n"] >= 3)
    found = found.groupBy(*CELL, "seq").agg(F.collect_list(F.struct("pos", "level", "stw", "sw")).alias("_of"))
    found = found.select(*[F.col(k).alias(f"_{k}") for k in (*CELL, "seq")], "_of")
    on = F.col("seq") == F.col("_seq")
    for k in CELL:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    each = builds.join(found.hint("merge"), on, "left").select("build_id", *CELL, F.explode("items").alias("x"), "_of")
    each = each.select("build_id", *CELL, "x.*", F.get(F.filter("_of", lambda y: y["pos"] == F.col("x.pos")), F.lit(0)).alias("t"))
    return each.select("build_id", *CELL, "pos", "material", "thickness", "t.level", ((F.col("t.stw") - F.col("thickness") * w) / (F.col("t.sw") - w)).alias("seq_mean"))


def leave_one_out(layers: DataFrame) -> DataFrame:
    """For each layer: mean of the layer at its place in other build-ups with the same sequence, by backoff.

    The own observation is subtracted from the totals, so no pair of build-ups is formed.
    """
    return _left_out(_builds(layers)).where("level IS NOT NULL").select("build_id", "pos", "level", "seq_mean")


def allocate(rows: DataFrame, base: str, total: str, key: str = "build_id") -> F.Column:
    """Model C's allocation: fixed layers keep their base, the others share what is left in proportion."""
    by = W.partitionBy(key)
    fixed = F.sum(F.when(F.col("fixed"), F.col(base)).otherwise(0.0)).over(by)
    free = F.sum(F.when(F.col("fixed"), 0.0).otherwise(F.col(base))).over(by)
    return F.when(F.col("fixed") | (free <= 0), F.col(base)).otherwise(F.greatest(F.lit(0.0), (F.col(total) - fixed) * F.col(base) / free))


def models(layers: DataFrame) -> DataFrame:
    """build_id, pos, thickness and the models' a, b, c, d for a total thickness equal to the build-up's own. All four models
    read the build-ups that are put together once; layers without a build_id have no leave-one-out mean."""
    builds = _builds(layers)
    loose = layers.where("build_id IS NULL").select("build_id", *CELL, "nettoflaeche", "pos", "material", "thickness")
    every = builds.select("build_id", *CELL, F.inline("items")).unionByName(loose)
    rows = _left_out(builds).drop("level").unionByName(loose.drop("nettoflaeche").withColumn("seq_mean", F.lit(None).cast("double")))
    # a row for each cell and material
    mean = stored(mean_thickness(every, every).select(*CELL, "material", F.col("t").alias("a")))
    rows = rows.join(F.broadcast(mean), [*CELL, "material"]).join(F.broadcast(medians(every)), "material")
    by = W.partitionBy("build_id")
    rows = rows.withColumn("total", F.sum("thickness").over(by)).withColumn("sum_a", F.sum("a").over(by)).withColumn("base_d", F.coalesce("seq_mean", "a"))
    b = F.when(F.col("sum_a") > 0, F.col("a") * F.col("total") / F.col("sum_a")).otherwise(F.col("a"))
    return rows.select("build_id", "pos", "material", "thickness", "a", b.alias("b"), allocate(rows, "a", "total").alias("c"), allocate(rows, "base_d", "total").alias("d"))


def catalog_total(layers: DataFrame, cells: DataFrame, default: float = 0.20) -> DataFrame:
    """cells with T: the median total thickness of the cell, (ort, art), art, or the default."""
    totals = layers.groupBy("build_id", *CELL).agg(F.sum("thickness").alias("staerke"))
    stats = leveled(totals, CELL).where("level < 3").groupBy("level", "key").agg(F.median("staerke").alias("T"), F.count(F.lit(1)).alias("n"))
    found = backoff(cells.select(*CELL).distinct(), stats, CELL, [], F.col("n") > 0)
    return cells.select(*CELL).distinct().join(found, CELL, "left").select(*CELL, F.coalesce("T", F.lit(default)).alias("T"))
