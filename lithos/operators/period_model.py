"""The period of a building in two stages: three coarse classes, then the classes after 1945; known periods win."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.operators.footprints import FEATURES
from lithos.operators.spatial import assemble_period
from lithos.session import cut, parts

#: Rows of the forests that one task takes.
ROWS_A_TASK = 20_000

#: Coarse classes in the order of their names, the coarse class of each fine one, and the fine classes of the last.
COARSE = ["1919-1945", "bis 1918", "nach 1945"]
COARSE_OF = {1: "bis 1918", 2: "1919-1945", 3: "nach 1945", 4: "nach 1945", 5: "nach 1945"}
LATE = [3, 4, 5]


def coarse_of_typology(text: Column) -> Column:
    """The coarse class of a typology's years, blanks aside; null for other texts."""
    s = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(s == "nach1945", "nach 1945").when(s.startswith("1919"), "1919-1945").when(s.isin("vor1848", "1848-1918", "1849-1859"), "bis 1918")


def known(rows: DataFrame, best_guess: str, typology: str) -> DataFrame:
    """Adds k5, the known fine class (null for 0), and k3, its coarse class or else that of the typology."""
    fine = F.when(F.col(best_guess) > 0, F.col(best_guess).cast("int"))
    coarse = F.element_at(F.create_map(*[F.lit(x) for kv in COARSE_OF.items() for x in kv]), fine)
    return rows.withColumns({"k5": fine, "k3": F.coalesce(coarse, coarse_of_typology(F.col(typology)))})


def late_shares(rows: DataFrame, late: Column, fine: Column) -> DataFrame:
    """Adds p_bp3, p_bp4, p_bp5: the probability of the last coarse class times those of its fine ones, to 3 digits."""
    return rows.withColumns({f"p_bp{c}": F.bround(late * F.coalesce(F.get(fine, F.lit(i)), F.lit(0.0)), 3) for i, c in enumerate(LATE)})


def vectors(rows: DataFrame, use: str) -> DataFrame:
    """Adds the vector of the features and one column per use; a missing use is one of its own. The rows are written first,
    since encoders and forests read them many times. Uses are a closed list of
    codes, so the encoder's table is small."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    rows = cut(rows.withColumn("_use", F.coalesce(F.col(use).cast("string"), F.lit("unk"))))
    rows = cut(rows.repartition(parts(rows, ROWS_A_TASK)))
    rows = StringIndexer(inputCol="_use", outputCol="_i", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    rows = OneHotEncoder(inputCol="_i", outputCol="_hot", dropLast=False).fit(rows).transform(rows)
    return VectorAssembler(inputCols=[*FEATURES, "_hot"], outputCol="features").transform(rows).drop("_use", "_i", "_hot")


def forest(rows: DataFrame, label: Column, leaf: int, trees: int, depth: int, seed: int):
    """A forest on the rows whose label (0, 1, ...) is known; None where there are none. Classes are not weighted."""
    from pyspark.ml.classification import RandomForestClassifier

    fit = rows.select("features", label.cast("double").alias("label")).where("label IS NOT NULL")
    if fit.isEmpty():
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, maxBins=256, seed=seed).fit(fit)


def probabilities(model, rows: DataFrame, name: str, n: int) -> DataFrame:
    """Adds the array of n class probabilities; classes that the model has not seen, and all without a model, have 0."""
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return rows.withColumn(name, F.array_repeat(F.lit(0.0), n))
    out = model.transform(rows).withColumn(name, vector_to_array("probability"))
    out = out.withColumn(name, F.array(*[F.coalesce(F.get(name, F.lit(i)), F.lit(0.0)) for i in range(n)]))
    return out.drop("rawPrediction", "probability", "prediction")


def coarse_label() -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, COARSE)), F.col("k3")), F.lit(0).cast("long")) - 1


def late_label() -> Column:
    return F.when(F.col("k5").isin(*LATE), F.col("k5") - LATE[0])


def two_stage(rows: DataFrame, key: str, trees: int = 100, depth: int = 12, seed: int = 42) -> DataFrame:
    """rows(key, features, k5, k3) -> key, bp5, coarse3, source, conf, p_bp3, p_bp4, p_bp5.

    The first forest learns the coarse classes from all rows with a known one, the second the late classes from those
    with a known fine one. Equal probabilities go to the first class.
    """
    first, second = forest(rows, coarse_label(), 3, trees, depth, seed), forest(rows, late_label(), 2, trees, depth, seed)
    if first is None or second is None:
        raise ValueError("both stages need rows with a known period")
    out = probabilities(second, probabilities(first, rows, "c1", len(COARSE)), "c2", len(LATE))
    best = lambda c: (F.array_max(c), F.array_position(c, F.array_max(c)).cast("int"))
    (p1, i1), (p2, i2) = best("c1"), best("c2")
    out = out.withColumns({"p1": p1, "s1": F.element_at(F.array(*map(F.lit, COARSE)), i1), "p2": p2, "s2": F.element_at(F.array(*map(F.lit, LATE)), i2)})
    out = late_shares(assemble_period(out), F.get("c1", F.lit(COARSE.index("nach 1945"))), F.col("c2"))
    return out.select(key, "bp5", "coarse3", "source", "conf", *[f"p_bp{c}" for c in LATE])


def spatial_fold(x: Column, y: Column, cell: float, folds: int = 5) -> Column:
    """The fold of a place: all of a cell are in one fold, so that neighbours are not learnt from. Cells are dealt by hash,
    which needs no count of them; null without a place."""
    at = F.concat_ws("_", F.bround(x / cell).cast("long").cast("string"), F.bround(y / cell).cast("long").cast("string"))
    return F.when(x.isNotNull() & y.isNotNull(), F.conv(F.substring(F.md5(at.cast("binary")), 1, 8), 16, 10).cast("long") % folds)


def cross_validated(rows: DataFrame, label: Column, n_classes: int, folds: int = 5, leaf: int = 3, trees: int = 60, depth: int = 12, seed: int = 42) -> DataFrame:
    """rows(features, fold) -> the labelled rows with truth and predicted, each from a forest that saw none of its fold."""
    rows = rows.withColumn("truth", label.cast("int")).where("truth IS NOT NULL AND fold IS NOT NULL")
    parts = []
    for k in range(folds):
        model = forest(rows.where(F.col("fold") != k), F.col("truth"), leaf, trees, depth, seed)
        part = probabilities(model, rows.where(F.col("fold") == k), "_p", n_classes)
        parts.append(part.withColumn("predicted", (F.array_position("_p", F.array_max("_p")) - 1).cast("int")).drop("_p"))
    return reduce(DataFrame.unionByName, parts)


def overall(rows: DataFrame) -> DataFrame:
    """rows(truth, predicted) -> n, accuracy, balanced_accuracy (the mean recall of the classes that occur)."""
    by = rows.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth").eqNullSafe(F.col("predicted"))).alias("hit"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum("hit"), F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"))
