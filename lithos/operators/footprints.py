"""Footprints as general rings: union by group, hulls, distances between outlines, and the features of the period model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions import rings
from lithos.session import cut, parts

#: Corners are snapped to this grid (metres), which also is the tolerance of a corner on another outline.
GRID_M = 1e-6
#: How far beside an edge, in units of the grid, it is asked what is covered: gaps and overlaps below are not seen.
ASIDE = 100
CELL = int(20.0 / GRID_M)
POINT = "struct<x:bigint,y:bigint>"


def _floor(value: Column, cell: float) -> Column:
    return F.floor(value / F.lit(float(cell))).cast("long")


def _snapped(ring: Column) -> Column:
    at = lambda v: F.round(v / GRID_M).cast("long")
    return F.transform(ring, lambda p: F.struct(at(p["x"]).alias("x"), at(p["y"]).alias("y")))


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once, wherever f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _minus(p: Column, q: Column) -> tuple[Column, Column]:
    """Differences are taken before they become doubles, so they are exact."""
    return (p["x"] - q["x"]).cast("double"), (p["y"] - q["y"]).cast("double")


def _cross(u, v) -> Column:
    return u[0] * v[1] - u[1] * v[0]


def _dot(u, v) -> Column:
    return u[0] * v[0] + u[1] * v[1]


def _edge_cells(p: Column, q: Column) -> Column:
    """The cells that an edge runs through: for each column of cells, the rows between its ends there."""
    x0, x1 = F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])
    slope = F.when(p["x"] == q["x"], None).otherwise((q["y"] - p["y"]) / (q["x"] - p["x"]).cast("double"))

    def rows(gx: Column) -> Column:
        low, high = F.greatest(x0, gx * CELL), F.least(x1, (gx + 1) * CELL)
        y = lambda x: F.coalesce(p["y"] + slope * (x - p["x"]), p["y"].cast("double"))
        a, b = y(low), F.when(slope.isNull(), q["y"].cast("double")).otherwise(y(high))
        return F.transform(F.sequence(_floor(F.least(a, b) - 2, CELL), _floor(F.greatest(a, b) + 2, CELL)), lambda gy: F.struct(gx.alias("gx"), gy.alias("gy")))

    return F.flatten(F.transform(F.sequence(_floor(x0 - 2, CELL), _floor(x1 + 2, CELL)), rows))


def _met(left: DataFrame, right: DataFrame, on: list[str], n: int, how: str = "inner") -> DataFrame:
    """A join in at least n tasks that sends neither side whole through the driver, however small its bytes are packed."""
    return left.repartition(n, *on).join(right.repartition(n, *on).hint("merge"), on, how)


def _split(edges: DataFrame, n: int) -> DataFrame:
    """edges(g, p, q), p < q, cut wherever they cross, touch or overlap one another: distinct pieces (g, p, q).

    Edges meet by group and cell, so a large group is spread over space; each pair is looked at from one side only, and a
    crossing is rounded once for both edges.
    """
    e = edges.withColumn("c", F.explode(_edge_cells(F.col("p"), F.col("q")))).select("g", "p", "q", "c.gx", "c.gy")
    o = e.select("g", F.col("p").alias("op"), F.col("q").alias("oq"), "gx", "gy")
    p, q, op, oq = (F.col(c) for c in ("p", "q", "op", "oq"))
    reach = lambda c, a, b: (F.least(a[c], b[c]) - 2, F.greatest(a[c], b[c]) + 2)
    near = [reach(c, p, q)[0] <= reach(c, op, oq)[1] for c in "xy"] + [reach(c, op, oq)[0] <= reach(c, p, q)[1] for c in "xy"]
    met = _met(e, o, ["g", "gx", "gy"], n).where((F.struct("p", "q") < F.struct("op", "oq")) & near[0] & near[1] & near[2] & near[3])

    def on(r: Column, a: Column, b: Column) -> Column:
        u, v = _minus(b, a), _minus(r, a)
        along = _dot(u, v)
        return (r != a) & (r != b) & (along > 0) & (along < _dot(u, u)) & (F.abs(_cross(u, v)) <= 1.5 * F.sqrt(_dot(u, u)))

    u, w, v = _minus(q, p), _minus(oq, op), _minus(op, p)
    d = F.nullif(_cross(u, w), F.lit(0.0))
    t, s = _cross(v, w) / d, _cross(v, u) / d
    ends = F.array(
        F.when(on(op, p, q), F.struct(p.alias("p"), q.alias("q"), op.alias("r"))), F.when(on(oq, p, q), F.struct(p.alias("p"), q.alias("q"), oq.alias("r"))),
        F.when(on(p, op, oq), F.struct(op.alias("p"), oq.alias("q"), p.alias("r"))), F.when(on(q, op, oq), F.struct(op.alias("p"), oq.alias("q"), q.alias("r"))),
    )
    ends = F.filter(ends, lambda x: x.isNotNull())
    at = F.struct((p["x"] + F.round(t * u[0]).cast("long")).alias("x"), (p["y"] + F.round(t * u[1]).cast("long")).alias("y"))
    crossing = F.array(F.struct(p.alias("p"), q.alias("q"), at.alias("r")), F.struct(op.alias("p"), oq.alias("q"), at.alias("r")))
    crossed = F.coalesce((t > 0) & (t < 1) & (s > 0) & (s < 1), F.lit(False))
    met = met.select("g", F.explode(_let(ends, lambda m: F.when(F.size(m) > 0, m).when(crossed, crossing))).alias("m"))
    cuts = met.select("g", "m.p", "m.q", "m.r").groupBy("g", "p", "q").agg(F.collect_set("r").alias("rs"))
    whole = _met(edges, cuts, ["g", "p", "q"], n, "left")
    placed = F.transform(F.coalesce("rs", F.array().cast(f"array<{POINT}>")), lambda r: F.struct(_dot(_minus(r, p), _minus(q, p)).alias("t"), r.alias("r")))
    corners = F.concat(F.array(p), F.transform(F.array_sort(placed), lambda x: x["r"]), F.array(q))
    pair = lambda a, b: F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))
    parts = _let(corners, lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda a, i: pair(a, F.get(c, i + 1))))
    return whole.select("g", F.explode(parts).alias("e")).select("g", "e.p", "e.q").where("p <> q").distinct()


def _outer(pieces: DataFrame, shapes: DataFrame, n: int) -> DataFrame:
    """The pieces with cover of shapes(g, ring) on one side only, as (g, e(a, b)) with the cover to the left."""
    p, q = F.col("p"), F.col("q")
    dx, dy = _minus(q, p)
    length = F.sqrt(dx * dx + dy * dy)
    mx, my = p["x"] + dx / 2, p["y"] + dy / 2
    at = pieces.withColumns({"mx": mx, "my": my, "nx": -dy / length * ASIDE, "ny": dx / length * ASIDE})
    at = at.withColumns({"gx": _floor(F.col("mx"), CELL), "gy": _floor(F.col("my"), CELL)})
    xs, ys = F.transform("ring", lambda r: r["x"]), F.transform("ring", lambda r: r["y"])
    shapes = shapes.select("g", "ring", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    rows = F.sequence(_floor(F.col("y0") - 2, CELL), _floor(F.col("y1") + 2, CELL))
    boxes = shapes.withColumn("gx", F.explode(F.sequence(_floor(F.col("x0") - 2, CELL), _floor(F.col("x1") + 2, CELL)))).withColumn("gy", F.explode(rows))
    by = F.col("mx").between(F.col("x0") - ASIDE, F.col("x1") + ASIDE) & F.col("my").between(F.col("y0") - ASIDE, F.col("y1") + ASIDE)
    inside = lambda k: rings.contains(F.col("ring"), F.col("mx") + k * F.col("nx"), F.col("my") + k * F.col("ny"))
    seen = _met(at, boxes, ["g", "gx", "gy"], n).where(by).groupBy("g", "p", "q").agg(F.max(inside(1)).alias("left"), F.max(inside(-1)).alias("right"))
    forth = F.struct(p.alias("a"), q.alias("b"))
    return seen.where("left <> right").select("g", F.when(F.col("left"), forth).otherwise(F.struct(q.alias("a"), p.alias("b"))).alias("e"))


def _stitched(halves: DataFrame, n: int) -> DataFrame:
    """(g, e(a, b)) -> g, ring: each edge is followed by the leftmost edge at its end; first corner the smallest edge's.

    The smallest edge of each ring and the steps to it are found by doubling, so the rounds grow with the logarithm of the
    longest ring. A round that changes nothing has compared every edge with its whole ring.
    """
    a, b = F.col("e.a"), F.col("e.b")
    leaving = halves.select("g", a.alias("at"), F.col("e").alias("n"))
    u, v = _minus(b, a), _minus(F.col("n.b"), F.col("n.a"))
    turn = F.atan2(_cross(u, v), _dot(u, v))
    follow = _met(halves.withColumn("at", b), leaving, ["g", "at"], n).groupBy("g", "e").agg(F.max_by("n", turn).alias("n"))
    state, step = cut(follow.withColumn("best", F.struct(F.col("e").alias("e"), F.lit(0).cast("long").alias("far")))), 1
    while True:
        ahead = state.select("g", F.col("e").alias("n"), F.col("n").alias("n2"), F.struct(F.col("best.e").alias("e"), (F.col("best.far") + step).alias("far")).alias("best2"))
        state = cut(_met(state, ahead, ["g", "n"], n).select("g", "e", F.col("n2").alias("n"), F.least("best", "best2").alias("best"), (F.col("best2") < F.col("best")).alias("moved")))
        if state.where("moved").isEmpty():
            break
        state, step = state.drop("moved"), step * 2
    place = F.struct(F.when(F.col("best.far") == 0, F.lit(-(1 << 62))).otherwise(-F.col("best.far")).alias("k"), (a["x"] * GRID_M).alias("x"), (a["y"] * GRID_M).alias("y"))
    found = state.groupBy("g", F.col("best.e").alias("first")).agg(F.sort_array(F.collect_list(place)).alias("ps"))
    points = F.transform("ps", lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y")))
    return found.select("g", F.concat(points, F.slice(points, 1, 1)).alias("ring"))


def dissolved(polygons: DataFrame, group: str, period: str, height: str) -> DataFrame:
    """polygons(group, ring, period, height) -> group, bp_code, height_m, rings, area, perimeter: one row per group.

    rings are the outlines of the union, the largest first: outer ones counter-clockwise, holes clockwise; polygons that
    touch, overlap, hold one another or stand twice count once. The period is the commonest, of several the smallest, 0 if
    none is known; the height is the largest, 0 if none is known. Rows without a group or a ring are left out. A group of
    one polygon keeps its ring and takes no part in the joins. A group's edges are spread over cells; only its result, the
    outline, is one row.
    """
    rows = polygons.where(F.col(group).isNotNull() & F.col("ring").isNotNull()).select(F.col(group).alias("g"), "ring", F.col(period).alias("_p"), F.col(height).cast("double").alias("_h"))
    facts = rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.mode("_p", True), F.lit(0)).cast("int").alias("bp_code"),
        F.coalesce(F.max("_h"), F.lit(0.0)).alias("height_m"), F.min("ring").alias("alone"),
    )
    facts = cut(facts)
    n = parts(rows, rings.POLYGONS_A_TASK)
    shapes = cut(_met(rows, facts.where("n > 1").select("g"), ["g"], n, "left_semi").select("g", _snapped(F.col("ring")).alias("ring")).distinct().repartition(n, "g", "ring"))
    sides = shapes.select("g", F.explode(F.transform(F.slice("ring", 1, F.greatest(F.size("ring") - 1, F.lit(0))), lambda p, i: F.struct(F.least(p, F.get("ring", i + 1)).alias("p"), F.greatest(p, F.get("ring", i + 1)).alias("q")))).alias("e"))
    sides = sides.select("g", "e.p", "e.q").where("p <> q").distinct()
    unions = _stitched(cut(_outer(_split(sides, n), shapes, n)), n)
    sized = F.struct(rings.signed_area(F.col("ring")).alias("a"), F.col("ring").alias("ring"))
    unions = unions.groupBy("g").agg(F.sort_array(F.collect_list(sized), asc=False).alias("rs"))
    out = _met(facts, unions, ["g"], n, "left")
    straight = F.when(rings.signed_area(F.col("alone")) < 0, F.reverse("alone")).otherwise(F.col("alone"))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    out = out.withColumn("rings", F.when(F.col("n") == 1, F.array(straight)).otherwise(F.coalesce(F.transform("rs", lambda r: r["ring"]), none)))
    total = lambda f: F.aggregate("rings", F.lit(0.0), lambda s, r: s + f(r))
    return out.select(F.col("g").alias(group), "bp_code", "height_m", "rings", total(rings.signed_area).alias("area"), total(rings.perimeter).alias("perimeter"))


def hull(ring: Column) -> Column:
    """The convex hull as a closed ring, counter-clockwise, without corners on straight sides: a fold over the sorted points
    that keeps the longest beginning of the chain from which the next point turns left."""
    points = F.array_distinct(F.array_sort(F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    empty = F.array().cast("array<struct<x:double,y:double>>")

    def left(h: Column, i: Column, p: Column) -> Column:
        a, b = F.get(h, i - 2), F.get(h, i - 1)
        return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]) > 0

    def chain(items: Column) -> Column:
        def step(h: Column, p: Column) -> Column:
            lengths = F.sequence(F.lit(2), F.greatest(F.size(h), F.lit(2)))
            keep = F.coalesce(F.array_max(F.filter(lengths, lambda i: left(h, i, p))), F.lit(1))
            return F.concat(F.slice(h, F.lit(1), keep), F.array(p))

        return F.aggregate(items, empty, step)

    half = lambda items: _let(chain(items), lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))))
    around = _let(points, lambda ps: F.concat(half(ps), half(F.reverse(ps))))
    return _let(around, lambda c: F.concat(c, F.slice(c, 1, 1)))


def hull_area(ring: Column) -> Column:
    return _let(hull(ring), rings.area)


def _aside2(x: Column, y: Column, e: Column) -> Column:
    """Squared distance from a point to an edge."""
    ux, uy, vx, vy = e["bx"] - e["ax"], e["by"] - e["ay"], x - e["ax"], y - e["ay"]
    along = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(vx * ux + vy * uy, ux * ux + uy * uy))), F.lit(0.0))
    return _let(along, lambda t: (vx - t * ux) * (vx - t * ux) + (vy - t * uy) * (vy - t * uy))


def outline_distance(a: Column, b: Column) -> Column:
    """Distance between two polygons: 0 if they touch, cross, or one holds the other."""
    return _let(rings.edges(a), lambda ea: _let(rings.edges(b), lambda eb: _edge_distance(a, b, ea, eb)))


def _edge_distance(a: Column, b: Column, ea: Column, eb: Column) -> Column:
    far = F.lit(float("inf"))
    near = F.aggregate(ea, far, lambda m, e: F.least(m, F.aggregate(eb, far, lambda k, f: F.least(k, _aside2(e["ax"], e["ay"], f), _aside2(f["ax"], f["ay"], e)))))
    side = lambda e, x, y: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    apart = lambda e, f: side(e, f["ax"], f["ay"]) * side(e, f["bx"], f["by"])
    crossed = F.exists(ea, lambda e: F.exists(eb, lambda f: (apart(e, f) < 0) & (apart(f, e) < 0)))
    first = lambda r: (F.get(r, F.lit(0))["x"], F.get(r, F.lit(0))["y"])
    return F.when(rings.contains(b, *first(a)) | rings.contains(a, *first(b)) | crossed, 0.0).otherwise(F.sqrt(near))


def _corners_within(a: Column, b: Column, radius: float) -> Column:
    """Whether two corners are within the radius, which settles most pairs before any edge is looked at."""
    d2 = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])
    return F.exists(a, lambda p: F.exists(b, lambda q: d2(p, q) <= radius * radius))


def outline_pairs(polygons: DataFrame, key: str, radius: float, cell: float = rings.CELL_M) -> DataFrame:
    """key, o_key, distance: every two polygons(key, ring) whose outlines are within the radius, once, key < o_key.

    Polygons meet by grid cells no smaller than the radius; a pair that shares several cells is looked at in one, the
    first that both have, so nothing is made distinct. Boxes that are too far apart are left out before edges are compared.
    """
    cell = max(cell, radius)
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    p = polygons.select(F.col(key).alias("k"), "ring", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1")).where("x0 IS NOT NULL AND k IS NOT NULL")

    def laid(wide: float) -> DataFrame:
        low = {"lx": _floor(F.col("x0") - wide, cell), "ly": _floor(F.col("y0") - wide, cell)}
        out = p.withColumns(low).withColumn("gx", F.explode(F.sequence("lx", _floor(F.col("x1") + wide, cell))))
        return out.withColumn("gy", F.explode(F.sequence("ly", _floor(F.col("y1") + wide, cell))))

    o = laid(0.0)
    o = o.select("gx", "gy", *[F.col(c).alias(f"o_{c}") for c in o.columns if c not in ("gx", "gy")])
    met = _met(laid(radius), o, ["gx", "gy"], parts(p, rings.POLYGONS_A_TASK)).where("k < o_k AND gx = greatest(lx, o_lx) AND gy = greatest(ly, o_ly)")
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"o_{c}0") - F.col(f"{c}1"), F.col(f"{c}0") - F.col(f"o_{c}1"))
    met = met.where(gap("x") * gap("x") + gap("y") * gap("y") <= radius * radius)
    near = _corners_within(F.col("ring"), F.col("o_ring"), radius) | (outline_distance(F.col("ring"), F.col("o_ring")) <= radius)
    return met.where(near).select(F.col("k").alias(key), F.col("o_k").alias(f"o_{key}"), outline_distance(F.col("ring"), F.col("o_ring")).alias("distance"))


def surroundings(polygons: DataFrame, key: str, radius: float) -> DataFrame:
    """key, n_nb, sum_nb_area, mean_nb_area, std_nb_area over the polygons within the radius of each outline; a polygon
    without neighbours has 0, 0 and nulls."""
    size = polygons.select(F.col(key).alias("_o"), rings.area(F.col("ring")).alias("_a"))
    pairs = outline_pairs(polygons, key, radius).select(key, F.col(f"o_{key}").alias("_o"))
    pairs = pairs.select(F.explode(F.array(F.struct(F.col(key).alias("k"), F.col("_o").alias("o")), F.struct(F.col("_o").alias("k"), F.col(key).alias("o")))).alias("m"))
    met = pairs.select(F.col("m.k").alias(key), F.col("m.o").alias("_o")).join(size, "_o").groupBy(key)
    facts = met.agg(F.count(F.lit(1)).alias("n_nb"), F.sum("_a").alias("sum_nb_area"), F.avg("_a").alias("mean_nb_area"), F.stddev_samp("_a").alias("std_nb_area"))
    return polygons.select(key).join(facts, key, "left").fillna(0, ["n_nb", "sum_nb_area"])


#: The area (m2) that stands for a full surrounding, and the most that its share counts.
FULL_M2, MOST_BUILT = 37000.0, 3.0
FEATURES = ["log_area", "log_vol", "vol_per_area", "m2bgf", "maxhoehe", "perim_m", "npoints", "compactness", "shape_idx", "solidity", "n_nb", "log_mean_area", "std_nb_area", "builtfrac"]


def period_features(buildings: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """key and the 14 features of buildings(key, ring, m3vol, m2bgf, maxhoehe) with context as of surroundings().

    Areas and lengths below 1 count as 1, a missing volume counts as 1 in its logarithm, all other missing figures as 0;
    npoints counts the closing corner.
    """
    r = F.col("ring")
    one = lambda c: F.greatest(c, F.lit(1.0))
    b = buildings.join(context, key, "left").withColumns({"_a": one(rings.area(r)), "perim_m": one(rings.perimeter(r)), "_h": one(hull_area(r))})
    a, p, volume = F.col("_a"), F.col("perim_m"), F.coalesce(F.col("m3vol").cast("double"), F.lit(0.0))
    made = {
        "log_area": F.ln(a), "log_vol": F.ln(one(volume)), "vol_per_area": F.greatest(volume, F.lit(0.0)) / a, "npoints": F.size(r).cast("double"),
        "compactness": 4 * F.pi() * a / (p * p), "shape_idx": p / F.sqrt(a), "solidity": F.least(F.lit(1.0), a / F.col("_h")),
        "log_mean_area": F.ln(one(F.coalesce("mean_nb_area", F.lit(0.0)))), "builtfrac": F.least(F.lit(MOST_BUILT), F.coalesce("sum_nb_area", F.lit(0.0)) / FULL_M2),
    }
    return b.withColumns(made).select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])
