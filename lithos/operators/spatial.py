"""Grid joins over points and footprints, and the period prediction built on their features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithos.session import parts

#: Points whose neighbours one task looks for.
POINTS_A_TASK = 10_000


def radius_pairs(points: DataFrame, radius: float, key: str) -> DataFrame:
    """points(key, x, y, ...) -> each point with every other within the radius (o_ columns and d2). A point meets the nine
    cells around its own, so the join is an equi-join on cells; a task has a bounded number of points, and no side is sent whole."""
    n = parts(points, POINTS_A_TASK)
    cx, cy = F.floor(F.col("x") / radius).cast("long"), F.floor(F.col("y") / radius).cast("long")
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = points.withColumn("_n", F.explode(near)).withColumns({"cx": cx + F.col("_n.i"), "cy": cy + F.col("_n.j")}).drop("_n")
    right = points.select(*[F.col(c).alias(f"o_{c}") for c in points.columns], cx.alias("cx"), cy.alias("cy"))
    d2 = (F.col("x") - F.col("o_x")) * (F.col("x") - F.col("o_x")) + (F.col("y") - F.col("o_y")) * (F.col("y") - F.col("o_y"))
    met = left.repartition(n, "cx", "cy").join(right.repartition(n, "cx", "cy").hint("merge"), ["cx", "cy"])
    return met.where((F.col(key) != F.col(f"o_{key}")) & (d2 <= radius * radius)).withColumn("d2", d2).drop("cx", "cy")


def neighbour_stats(buildings: DataFrame, radius: float) -> DataFrame:
    """Number, sum, mean and sample deviation of the areas around each building."""
    c = buildings.select("bw_geb_id", (F.col("x0") + F.col("wx") / 2).alias("x"), (F.col("y0") + F.col("wy") / 2).alias("y"), (F.col("wx") * F.col("wy")).alias("area"))
    return radius_pairs(c, radius, "bw_geb_id").groupBy("bw_geb_id").agg(F.count(F.lit(1)).alias("n_nb"), F.round(F.sum("o_area"), 6).alias("sum_area"), F.round(F.avg("o_area"), 6).alias("mean_area"), F.round(F.stddev_samp("o_area"), 6).alias("std_area"))


def within_rectangles(points: DataFrame, rects: DataFrame, cell: float = 20.0) -> DataFrame:
    """pt and the first rectangle (by id) that holds it."""
    span = lambda a, w: F.sequence(F.floor(F.col(a) / cell).cast("long"), F.floor((F.col(a) + F.col(w)) / cell).cast("long"))
    r = rects.select("bw_geb_id", "x0", "y0", "wx", "wy", F.explode(span("x0", "wx")).alias("cx")).select("*", F.explode(span("y0", "wy")).alias("cy"))
    p = points.withColumns({"cx": F.floor(F.col("x") / cell).cast("long"), "cy": F.floor(F.col("y") / cell).cast("long")})
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("wx")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("wy"))
    return p.join(r, ["cx", "cy"]).where(inside).groupBy("pt").agg(F.min("bw_geb_id").alias("bw_geb_id"))


def assemble_period(rows: DataFrame) -> DataFrame:
    """rows(k5, k3, s1, s2, p1, p2) with bp5, coarse3, source and conf: known fine beats known coarse beats predicted."""
    coarse = F.coalesce("k3", "s1")
    rows = rows.withColumn("coarse3", coarse)
    late, known = F.col("coarse3") == "nach 1945", F.col("k3").isNotNull()
    bp5 = F.coalesce("k5", F.when(F.col("coarse3") == "bis 1918", 1).when(F.col("coarse3") == "1919-1945", 2).otherwise(F.col("s2")))
    conf = F.when(F.col("k5").isNotNull(), 1.0).when(~late, F.when(known, 1.0).otherwise(F.bround("p1", 3))).otherwise(F.bround(F.when(known, F.col("p2")).otherwise(F.col("p1") * F.col("p2")), 3))
    return rows.withColumns({"bp5": bp5, "source": F.when(F.col("k5").isNotNull(), "known_bp").when(known, "known_coarse").otherwise("predicted"), "conf": conf})


def class_metrics(rows: DataFrame) -> DataFrame:
    """rows(truth, predicted) -> class, n, f1, recall; one pass over the confusion counts."""
    cells = rows.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("c"))
    as_truth = cells.select(F.col("truth").alias("class"), F.col("c").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("c")).otherwise(0).alias("hit"))
    as_pred = cells.select(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("t"), F.col("c").alias("p"), F.lit(0).cast("long").alias("hit"))
    s = as_truth.union(as_pred).groupBy("class").agg(F.sum("t").alias("n"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.try_divide(a, b)
    return s.select("class", "n", F.round(F.coalesce(ratio(2 * F.col("hit"), F.col("n") + F.col("p")), F.lit(0.0)), 8).alias("f1"), F.round(ratio(F.col("hit"), F.col("n")), 8).alias("recall"))


def predict_period(buildings: DataFrame, trees: int = 40, seed: int = 42) -> DataFrame:
    """A random forest over the geometry features for the buildings whose period is known."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = ["log_area", "log_vol", "perim", "compactness", "maxhoehe", "m2bgf"]
    area, perim = F.col("wx") * F.col("wy"), 2 * (F.col("wx") + F.col("wy"))
    rows = buildings.select("bw_geb_id", F.col("bp_best_guess").cast("double").alias("label"), F.ln(area).alias("log_area"), F.ln(F.greatest("m3vol", F.lit(1.0))).alias("log_vol"), perim.alias("perim"), (4 * F.pi() * area / (perim * perim)).alias("compactness"), "maxhoehe", "m2bgf")
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=trees, minInstancesPerNode=3, seed=seed).fit(rows.where("label > 0"))
    return model.transform(rows).select("bw_geb_id", F.col("prediction").cast("int").alias("bp"))


def any_of(conditions: list) -> F.Column:
    return reduce(lambda a, b: a | b, conditions)
