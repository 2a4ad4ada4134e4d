"""Parametric building geometry and the city's material balance, on axis-aligned footprints (x0, y0, wx, wy).

Neighbours are found through grid cells: each footprint goes to the cells that its outline meets, an equi-join brings
together what shares a cell, and the shared edge length is exact. No range self-join is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.functions.periods import collapse_bp, label
from lithos.operators.markov import CELL, beam_predict, distributions, sequences
from lithos.operators.thickness import allocate, catalog_total, mean_thickness, medians
from lithos.vocab import DENSITY, DENSITY_DEFAULT, IW_LAYERS, IW_LFM, OPEN_AW, OPEN_IW, PERIOD_METRICS

CELL_M = 20.0


def by_code(table: dict, fallback: float, code="bp_code") -> F.Column:
    if not table:
        return F.lit(fallback)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in (kv[0], float(kv[1]))]), F.col(code)), F.lit(fallback))


def calibrated(calibration: DataFrame | None) -> dict[str, dict[int, float]]:
    """calibration(period, metric, value) -> metric -> value by period code; at most a row for each period and metric."""
    out: dict[str, dict[int, float]] = {}
    for r in calibration.where(F.col("metric").isin(*PERIOD_METRICS)).select("period", "metric", "value").collect() if calibration is not None else ():
        out.setdefault(r[1], {})[int(r[0])] = float(r[2])
    return out


def metric(name: str, calibration: dict[str, dict[int, float]] | None = None) -> F.Column:
    """A metric by period code: the calibrated value, else the table's, else the fallback."""
    table, fallback = PERIOD_METRICS[name]
    return by_code({**table, **(calibration or {}).get(name, {})}, fallback)


def touching(buildings: DataFrame, key: str = "bw_geb_id", cell: float = CELL_M) -> DataFrame:
    """key, touching: length of each footprint's outline that lies on other footprints' outlines."""
    span = lambda a, w: F.sequence(F.floor(F.col(a) / cell).cast("int"), F.floor((F.col(a) + F.col(w)) / cell).cast("int"))
    cells = buildings.select(key, "x0", "y0", "wx", "wy", F.explode(span("x0", "wx")).alias("cx"), "y0").select(key, "x0", buildings["y0"], "wx", "wy", "cx", F.explode(span("y0", "wy")).alias("cy"))
    other = cells.select(*[F.col(c).alias(f"o_{c}") for c in (key, "x0", "y0", "wx", "wy")], "cx", "cy")
    met = cells.join(other, ["cx", "cy"]).where(F.col(key) != F.col(f"o_{key}"))
    x1, y1, ox1, oy1 = F.col("x0") + F.col("wx"), F.col("y0") + F.col("wy"), F.col("o_x0") + F.col("o_wx"), F.col("o_y0") + F.col("o_wy")
    across = F.greatest(F.lit(0.0), F.least(x1, ox1) - F.greatest("x0", "o_x0"))
    along = F.greatest(F.lit(0.0), F.least(y1, oy1) - F.greatest("y0", "o_y0"))
    same = lambda a, b: F.when(a == b, 1).otherwise(0)
    shared = across * (same(F.col("y0"), F.col("o_y0")) + same(F.col("y0"), oy1) + same(y1, F.col("o_y0")) + same(y1, oy1)) + along * (same(F.col("x0"), F.col("o_x0")) + same(F.col("x0"), ox1) + same(x1, F.col("o_x0")) + same(x1, ox1))
    return met.select(key, f"o_{key}", shared.alias("shared")).where("shared > 0").distinct().groupBy(key).agg(F.sum("shared").alias("touching"))


def parametric(buildings: DataFrame, calibration: DataFrame | None = None) -> DataFrame:
    """Derived geometry of each building; calibration(period, metric, value) overrides the metrics of periods."""
    values = calibrated(calibration)
    b = buildings.withColumn("bp_code", collapse_bp(F.col("bp"))).join(touching(buildings), "bw_geb_id", "left")
    t, h = metric("wall_thickness_m", values), metric("storey_height_m", values)
    gross = F.col("wx") * F.col("wy")
    b = b.withColumns({"wall_thickness_m": t, "gross": gross, "perimeter": 2 * (F.col("wx") + F.col("wy"))})
    net = F.greatest(F.lit(0.0), F.col("wx") - 2 * F.col("wall_thickness_m")) * F.greatest(F.lit(0.0), F.col("wy") - 2 * F.col("wall_thickness_m"))
    b = b.withColumns({"net": net, "touch": F.least(F.coalesce("touching", F.lit(0.0)), F.col("perimeter")), "storeys": F.when(F.coalesce("maxhoehe", F.lit(0.0)) == 0, 1).otherwise(F.greatest(F.lit(1), F.bround(F.col("maxhoehe") / h).cast("int")))})
    return b.select("bw_geb_id", "bp_code", label(F.col("bp_code")).alias("bauperiode"), "storeys", metric("keller_geschosse", values).cast("int").alias("keller"), F.least(metric("dachgeschosse", values).cast("int"), F.col("storeys")).alias("dach"), F.bround("maxhoehe", 2).alias("height_m"), "wall_thickness_m", F.bround("gross", 2).alias("gross_area_m2"), F.bround("net", 2).alias("net_area_m2"), F.when(F.col("gross") > 0, F.bround(1 - F.col("net") / F.col("gross"), 4)).otherwise(0.0).alias("percentage_wall"), F.bround(F.col("perimeter") - F.col("touch"), 2).alias("free_m"), F.bround("touch", 2).alias("touching_m"), F.bround(metric("interior_wall_lfm_per_m2", values) * F.col("net"), 2).alias("interior_m"), F.bround(F.col("gross") * F.col("storeys"), 2).alias("floor_area_m2"), F.bround(F.col("gross") * metric("roof_area_factor", values), 2).alias("roof_area_m2"), F.bround(F.greatest("wx", "wy"), 2).alias("length_m"))


def floors() -> F.Column:
    return F.array(F.struct(F.lit("KG").alias("ort"), F.col("keller").alias("n")), F.struct(F.lit("RG").alias("ort"), F.greatest(F.lit(0), F.col("storeys") - F.col("dach")).alias("n")), F.struct(F.lit("DG").alias("ort"), F.col("dach").alias("n")))


def elements(facts: DataFrame) -> DataFrame:
    """bw_geb_id, bauperiode, bp_code, wall_thickness_m, ort, art, area of outer walls, floors and the roof."""
    h = F.when(F.col("storeys") > 0, F.col("height_m") / F.col("storeys")).otherwise(3.0)
    p = F.col("free_m") + 0.5 * F.col("touching_m")
    open_ = 1.0 - by_code(OPEN_AW, 0.25)
    x = facts.withColumn("f", F.explode(floors())).where("f.n > 0")
    keep = ["bw_geb_id", "bauperiode", "bp_code", "wall_thickness_m"]
    walls = x.select(*keep, "f.ort", F.explode(F.array(F.struct(F.lit("AW").alias("art"), (p * h * F.col("f.n") * open_).alias("area")), F.struct(F.lit("FB").alias("art"), (F.col("gross_area_m2") * F.col("f.n")).alias("area")))).alias("e")).select(*keep, "ort", "e.art", "e.area")
    return walls.unionByName(facts.select(*keep, F.lit("DG").alias("ort"), F.lit("D").alias("art"), F.col("roof_area_m2").alias("area"))).where("area > 0")


def interior(facts: DataFrame) -> DataFrame:
    """bw_geb_id, bauperiode, kind, material, thickness, area of interior walls."""
    h = F.when(F.col("storeys") > 0, F.col("height_m") / F.col("storeys")).otherwise(3.0)
    bearing = by_code(IW_LFM["tragend"], 0.12) * F.col("net_area_m2")
    chimney = F.least(F.col("length_m"), bearing)
    run = {"tragend": chimney, "wohnung": F.greatest(F.lit(0.0), bearing - chimney), "leicht": by_code(IW_LFM["leicht"], 0.30) * F.col("net_area_m2")}
    opening = {"tragend": by_code(OPEN_IW["tragend"], 0.08), "wohnung": by_code(OPEN_IW["tragend"], 0.08), "leicht": by_code(OPEN_IW["leicht"], 0.20)}

    def layers(kind: str) -> F.Column:
        arrays = {c: F.array(*[F.struct(F.lit(m).alias("material"), F.lit(t).alias("thickness")) for m, t in v]) for c, v in IW_LAYERS[kind].items()}
        out = arrays[0]
        for c, v in arrays.items():
            out = F.when(F.col("bp_code") == c, v).otherwise(out)
        return out

    storeys = F.aggregate(F.filter(floors(), lambda f: f["n"] > 0), F.lit(0), lambda s, f: s + f["n"])
    x = facts.withColumn("n", storeys)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), (run[k] * h * F.col("n") * (1.0 - opening[k])).alias("area"), layers(k).alias("layers")) for k in run])
    rows = x.select("bw_geb_id", "bauperiode", F.explode(kinds).alias("k")).where("k.area > 0")
    return rows.select("bw_geb_id", "bauperiode", "k.kind", "k.area", F.explode("k.layers").alias("l")).select("bw_geb_id", "bauperiode", "kind", "l.material", "l.thickness", "area")


def density(material: F.Column) -> F.Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DENSITY.items() for x in (kv[0], float(kv[1]))]), material), F.lit(float(DENSITY_DEFAULT)))


def profiles(facts: DataFrame, layers: DataFrame) -> DataFrame:
    """bauperiode, ort, art, material, thickness: the likeliest build-up of each cell that the elements have, laid out on
    the cell's total thickness T by the cover and filling layers' rule.

    T is the wall thickness for AW, else the catalog's median. Sequences, means and T back off to coarser cells, so a cell
    without catalog rows, such as one of an unknown period, has a profile too. The result has a few rows per cell.
    """
    cells = elements(facts).select(*CELL, F.when(F.col("art") == "AW", F.col("wall_thickness_m")).alias("wall")).distinct()
    sequences_ = sequences(layers)
    top = beam_predict(cells, distributions(sequences_), k=1).select(*CELL, F.posexplode(F.split("seq", ";")).alias("pos", "material"))
    means = mean_thickness(top, layers).select(*CELL, "material", F.col("t").alias("a"))
    rows = top.join(means, [*CELL, "material"], "left").join(F.broadcast(medians(layers)), "material", "left")
    rows = rows.join(cells, CELL).join(catalog_total(layers, cells), CELL)
    rows = rows.withColumns({"a": F.coalesce("a", F.lit(0.0)), "fixed": F.coalesce("fixed", F.lit(False)), "total": F.round(F.coalesce("wall", "T"), 4), "profile": F.concat_ws("|", *CELL)})
    return rows.select(*CELL, "material", allocate(rows, "a", "total", "profile").alias("thickness"))


def balance(facts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Volume and mass facts per building, element and material.

    profiles(bauperiode, ort, art, material, thickness): the layers of a cell's build-up, a few hundred rows at any city
    size. An element whose cell has none stays, with a null material and no volume.
    """
    e = elements(facts).join(F.broadcast(profiles), ["bauperiode", "ort", "art"], "left")
    shell = e.select("bauperiode", F.concat_ws("/", "ort", "art").alias("element"), "material", F.coalesce(F.col("area") * F.col("thickness"), F.lit(0.0)).alias("volume"))
    walls = interior(facts).select("bauperiode", F.concat(F.lit("IW/"), F.col("kind")).alias("element"), "material", (F.col("area") * F.col("thickness")).alias("volume"))
    return shell.unionByName(walls).withColumn("mass", F.col("volume") * density(F.col("material")))
