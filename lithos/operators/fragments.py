"""Walls from fragments: pieces of one line joined, and the two scanned faces of a wall made one.

Fragments come as rows (scan_id, id, x1, y1, x2, y2, z_base, height, thickness), ids unique in a scan. Two are compared in the
direction midway between theirs: the offset of their middles across it, their spans along it.

Fragments are dealt into tasks by tiles of space, once each and to further tiles only if what they can link with may stand
there; in a task, pairs come from cells of direction, length and middle and not from a comparison of all pairs, and each pair
is looked at once. Equal fragments of a wall are one. Groups are the components of the links, put together in the tasks of
their scans, and a group's wall comes from aggregates only, so no group is in one row.

Edge cases: a fragment with a null among its figures or its scan links to none and is left out; a fragment without length
has direction 0; a scan without links keeps its fragments as walls; no rows give no walls.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithos.operators.components import components
from lithos.session import parts, ship_package, stored

ANGLE_TOL = 12.0
#: Bins of direction, wider than the tolerance, so that two that link are in one bin or in neighbours.
BINS = int(180 / ANGLE_TOL) - 1
EPS = 1e-9
#: Links that a task reduces at once, and pairs that it looks at at once.
BLOCK = 1_000_000
#: Fragments that a task takes, and the length up to which they stand in the smallest tiles; each further size is for four
#: times the length.
FRAGMENTS_A_TASK, TILE_LENGTH = 100_000, 16.0
SHAPE = ["x1", "y1", "x2", "y2", "z_base", "height", "thickness"]


def _figures(rows: DataFrame) -> DataFrame:
    """Whole rows with middle, length and direction (radians, 0 to below pi)."""
    whole = rows.select("scan_id", "id", *SHAPE).dropna()
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return whole.withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2, "len": length, "dir": _direction()})


def _direction() -> F.Column:
    turn = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    turn = F.when(turn < 0, turn + F.pi()).otherwise(turn)
    return F.when(turn >= F.pi(), turn - F.pi()).otherwise(turn)


def _tiles(rows: DataFrame, far, longest: float) -> DataFrame:
    """rows with their tiles (_c the tile's size, _i, _j), whether a tile is the fragment's own (home) and of its own size
    (asks): it stands in one tile of its own and of each larger size, and asks in all that its reach touches."""
    most = max(0, math.ceil(math.log2(max(longest, 1.0) / TILE_LENGTH) / 2))
    class_ = F.when(F.col("len") > TILE_LENGTH, F.ceil(F.log2(F.col("len") / TILE_LENGTH) / 2)).otherwise(0).cast("int")
    size = lambda c: 4 * far(TILE_LENGTH * F.pow(F.lit(4.0), c))
    at = lambda x: F.floor(x / F.col("_size")).cast("long")
    own = rows.select("scan_id", "id", *SHAPE, "mx", "my", far(F.col("len")).alias("_reach"), (class_ if most else F.lit(0)).alias("_c"))
    asking = own.withColumn("_size", size(F.col("_c")))
    for k, m in (("_i", "mx"), ("_j", "my")):
        asking = asking.withColumn(k, F.explode(F.sequence(at(F.col(m) - F.col("_reach")), at(F.col(m) + F.col("_reach")))))
    home = (F.col("_i") == at(F.col("mx"))) & (F.col("_j") == at(F.col("my")))
    out = ["scan_id", "id", *SHAPE, "_c", "_i", "_j", "home", "asks"]
    dealt = asking.withColumns({"home": home, "asks": F.lit(True)}).select(*out)
    if not most:
        return dealt
    larger = own.where(F.col("_c") < most).withColumn("_c", F.explode(F.sequence(F.col("_c") + 1, F.lit(most)))).withColumn("_size", size(F.col("_c")))
    return dealt.union(larger.withColumns({"_i": at(F.col("mx")), "_j": at(F.col("my")), "home": F.lit(True), "asks": F.lit(False)}).select(*out))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values, equal ones for equal values."""
    return np.unique(column.to_numpy() if pa.types.is_integer(column.type) else np.array(column.to_pylist(), dtype=object), return_inverse=True)[1].astype(np.int64)


def _runs(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the run, place) of all places of runs from low to below high, about BLOCK at once."""
    count = high - low
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        n = count[at:to]
        run = np.repeat(np.arange(at, to), n)
        yield run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + low[run]
        at = to


def _near(x: dict[str, np.ndarray], along, offset: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, common, union) of the fragments of a task that can link, each pair once, close enough across: what their spans
    along the middle direction have in common (below 0: less the gap) and their union.

    along(length of the longer) bounds how far apart the middles of two that link are along their direction, offset how far
    across. Each pair is found from its longer fragment, of equal ones the one with the smaller id: that one asks for the
    cells around its middle, turned into the direction of its own bin, where the others of this and the next bins stand at
    their middles. Cells are as large as the asker's class of length needs, so few are asked for whatever the length.
    """
    # the middle direction is within half a bin and half the tolerance of the bin's
    lean = math.sin(math.pi / BINS / 2 + math.radians(ANGLE_TOL / 2) + 1e-9)
    far = lambda length: along(length) + offset + 1e-6
    wide = lambda length: offset + along(length) * lean + 1e-6
    length, mx, my, turn, tile = x["len"], x["mx"], x["my"], x["dir"], x["tile"]
    class_ = np.maximum(0, np.ceil(np.log2(np.where(length > 0, length, 1.0)) / 2)).astype(np.int64)
    bin_ = np.minimum(np.floor(turn * (BINS / math.pi)), BINS - 1).astype(np.int64)

    def placed(rows: np.ndarray, k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        angle, size = k * (math.pi / BINS) + math.pi / BINS / 2, 4.0**c
        cos, sin = np.cos(angle), np.sin(angle)
        return mx[rows] * cos + my[rows] * sin, my[rows] * cos - mx[rows] * sin, 2 * far(size), 2 * wide(size)

    def number(rows: np.ndarray, k: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """One number for a cell; the few that share one are told apart by their tiles and places."""
        low = ((i.astype(np.int64) & 0xFFFF) << 16) | (j.astype(np.int64) & 0xFFFF)
        return ((((tile[rows] & 0x3FFFFF) * 16 + k) * 32 + c) << 32) | low

    asks, home = np.flatnonzero(x["asks"]), np.flatnonzero(x["home"])
    asked = np.zeros((BINS, 33), bool)
    asked[bin_[asks], np.minimum(class_[asks], 32)] = True
    keys, whose = [], []
    for c in np.unique(class_[asks]):
        for step in (-1, 0, 1):
            k = (bin_[home] + step) % BINS
            kept = (class_[home] <= c) & asked[k, min(c, 32)]
            rows, k = home[kept], k[kept]
            u, v, cu, cv = placed(rows, k, np.full(len(rows), c))
            keys.append(number(rows, k, np.full(len(rows), c & 31), np.floor(u / cu), np.floor(v / cv)))
            whose.append(rows)
    if not keys:
        return
    key, who = np.concatenate(keys), np.concatenate(whose)
    order = np.argsort(key, kind="stable")
    key, who = key[order], who[order]
    u, v, cu, cv = placed(asks, bin_[asks], class_[asks])
    r, s = far(length[asks]), wide(length[asks])
    i0, i1, j0, j1 = np.floor((u - r) / cu), np.floor((u + r) / cu), np.floor((v - s) / cv), np.floor((v + s) / cv)
    for di in range(int((i1 - i0).max()) + 1):
        for dj in range(int((j1 - j0).max()) + 1):
            some = (i0 + di <= i1) & (j0 + dj <= j1)
            rows = asks[some]
            cell = number(rows, bin_[rows], class_[rows] & 31, i0[some] + di, j0[some] + dj)
            for run, at in _runs(np.searchsorted(key, cell, "left"), np.searchsorted(key, cell, "right")):
                a, b = rows[run], who[at]
                kept = (tile[a] == tile[b]) & ((length[a] > length[b]) | ((length[a] == length[b]) & (x["rank"][a] < x["rank"][b])))
                a, b = a[kept], b[kept]
                dx, dy, most = mx[b] - mx[a], my[b] - my[a], far(length[a])
                apart = np.abs(turn[a] - turn[b])
                least = np.minimum(apart, math.pi - apart)
                kept = (dx * dx + dy * dy <= most * most) & (np.degrees(least) <= ANGLE_TOL + EPS)
                a, b, dx, dy, apart, least = (y[kept] for y in (a, b, dx, dy, apart, least))
                # directions on both sides of 0 have their middle beyond pi / 2 from the plain mean
                mean = (turn[a] + turn[b]) / 2 + np.where(apart > math.pi / 2, math.pi / 2, 0.0)
                ux, uy = np.cos(mean), np.sin(mean)
                kept = np.abs(dy * ux - dx * uy) <= offset + EPS
                # both lean from the middle direction by half the angle
                lean_by = np.cos(least[kept] / 2)
                apart_by = np.abs(dx * ux + dy * uy)[kept]
                a, b = a[kept], b[kept]
                ha, hb = length[a] / 2 * lean_by, length[b] / 2 * lean_by
                yield a, b, np.minimum(ha, apart_by + hb) - np.maximum(-ha, apart_by - hb), np.maximum(ha, apart_by + hb) + np.maximum(ha, hb - apart_by)


def _links(rows: DataFrame, along, offset: float, ok, same: bool = False) -> DataFrame:
    """(scan_id, a, b) of a scan's pairs that pass ok(common, union, figures, a, b), each once and a < b. rows are read
    twice. With same, equal fragments take part as one, the least of them, and are linked to it."""
    ship_package(rows.sparkSession)
    far = lambda length: along(length) + offset + 1e-6
    figures = _figures(rows)
    longest = figures.agg(F.max("len")).first()[0] or 0.0
    dealt = _tiles(figures, far, longest).repartition(parts(rows, FRAGMENTS_A_TASK), "scan_id", "_c", "_i", "_j")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        ids, scans, rank = table["id"].combine_chunks(), table["scan_id"].combine_chunks(), _codes(table["id"])

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            low, high = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
            return pa.RecordBatch.from_arrays([scans.take(pa.array(a)), ids.take(pa.array(low)), ids.take(pa.array(high))], names=["scan_id", "a", "b"])

        tile = _codes(table["scan_id"])
        for k in ("_c", "_i", "_j"):
            at = _codes(table[k])
            tile = np.unique(tile * (at.max() + 1) + at, return_inverse=True)[1].astype(np.int64)
        x = {k: table[k].to_numpy() + 0.0 for k in SHAPE} | {k: table[k].to_numpy() for k in ("home", "asks")} | {"tile": tile, "rank": rank}
        index = np.arange(len(rank))
        if same:
            order = np.lexsort((rank, *[x[k] for k in SHAPE], tile))
            first = np.ones(len(order), bool)
            first[1:] = np.any([x[k][order][1:] != x[k][order][:-1] for k in (*SHAPE, "tile")], axis=0)
            lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            more = ~first & (x["home"] & x["asks"])[order]
            if more.any():
                yield out(lead[more], order[more])
            index = np.sort(order[first])
            x = {k: v[index] for k, v in x.items()}
        dx, dy = x["x2"] - x["x1"], x["y2"] - x["y1"]
        turn = np.arctan2(dy, dx)
        turn = np.where(turn < 0, turn + math.pi, turn)
        x |= {"mx": (x["x1"] + x["x2"]) / 2, "my": (x["y1"] + x["y2"]) / 2, "len": np.hypot(dx, dy), "dir": np.where(turn >= math.pi, turn - math.pi, turn)}
        for a, b, common, union in _near(x, along, offset):
            kept = ok(common, union, x, a, b)
            if kept.any():
                yield out(index[a[kept]], index[b[kept]])

    kinds = dict(rows.dtypes)
    return dealt.mapInArrow(task, f"scan_id {kinds['scan_id']}, a {kinds['id']}, b {kinds['id']}")


def _forest(links: DataFrame) -> DataFrame:
    """Links (scan_id, a, b) with the same components and at most one for each node. A scan's links are reduced a BLOCK at a
    time in one task; whole tells that a is its component's least node, which fails only where more than half a BLOCK is left
    of a task's links."""
    ship_package(links.sparkSession)

    def reduced(table: pa.Table) -> pa.RecordBatch:
        a, b, scan_id = (table[k].combine_chunks() for k in ("a", "b", "scan_id"))
        scans = _codes(table["scan_id"])
        at = _codes(pa.chunked_array([a, b]))
        nodes, place, code = np.unique(np.concatenate((scans, scans)) * (at.max() + 1) + at, return_index=True, return_inverse=True)
        p, q = code[: len(a)], code[len(a) :]
        label = np.arange(len(nodes))
        while len(p):
            low, high = np.minimum(label[p], label[q]), np.maximum(label[p], label[q])
            p, q = (x[low != high] for x in (p, q))
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
        out = np.flatnonzero(label != np.arange(len(nodes)))
        ids = pa.concat_arrays([a, b])
        return pa.RecordBatch.from_arrays([scan_id.take(pa.array(place[out] % len(a))), ids.take(pa.array(place[label[out]])), ids.take(pa.array(place[out]))], names=["scan_id", "a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, n, whole = ["scan_id", "a", "b"], [], 0, True
        for batch in batches:
            if batch.num_rows:
                held.append(batch.select(names))
                n += batch.num_rows
            if n >= BLOCK:
                held = [reduced(pa.Table.from_batches(held))]
                n = held[0].num_rows
                if n >= BLOCK // 2:
                    whole, n, part = False, 0, held.pop()
                    yield part.append_column("whole", pa.array(np.zeros(part.num_rows, bool)))
        if held:
            end = reduced(pa.Table.from_batches(held))
            yield end.append_column("whole", pa.array(np.full(end.num_rows, whole)))

    kinds = dict(links.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in ("scan_id", "a", "b")) + ", whole boolean"
    near = links.mapInArrow(task, schema).drop("whole")
    return near.repartition("scan_id").mapInArrow(task, schema)


def _collinear(rows: DataFrame, offset: float, gap: float, height: float, base_jump: float, same: bool = False) -> DataFrame:
    def ok(common, union, x, a, b):
        base, top = np.abs(x["z_base"][a] - x["z_base"][b]), x["z_base"] + x["height"]
        return (-common <= gap + EPS) & (base <= min(height, base_jump) + EPS) & (np.abs(top[a] - top[b]) <= height + EPS)

    return _links(rows, lambda length: length + gap, offset, ok, same)


def _faces(rows: DataFrame, thickness: float, overlap: float, same: bool = False) -> DataFrame:
    share = max(0.0, overlap - EPS)
    ok = lambda common, union, x, a, b: (common > EPS) & (common >= (overlap - EPS) * union)
    # middles s apart have (l - s) of (l + s) in common, with l the mean of both lengths
    return _links(rows, lambda length: length * ((1 - share) / (1 + share)), thickness, ok, same)


def _whole(rows: DataFrame) -> DataFrame:
    return stored(rows.select("scan_id", "id", *SHAPE).dropna())


def collinear_links(rows: DataFrame, offset: float = 0.20, gap: float = 0.8, height: float = 3.0, base_jump: float = 1.2) -> DataFrame:
    """(scan_id, a, b) of fragments on one line: the gap between their spans, their bases and tops within the limits."""
    return _collinear(_whole(rows), offset, gap, height, base_jump)


def face_links(rows: DataFrame, thickness: float = 0.40, overlap: float = 0.40) -> DataFrame:
    """(scan_id, a, b) of two faces of a wall: no more than a thickness apart, spans with that share of their union in common."""
    return _faces(_whole(rows), thickness, overlap)


def _walls(rows: DataFrame, links, faces: bool) -> DataFrame:
    shapes = _whole(rows)
    forest = stored(_forest(links(shapes)))
    found = forest.where("whole").select("scan_id", F.col("b").alias("id"), F.col("a").alias("wall"))
    rest = forest.where("NOT whole")
    if not rest.isEmpty():
        node = lambda k: F.struct("scan_id", F.col(k).alias("id"))
        more = components(rest.select(node("a").alias("a"), node("b").alias("b")))
        found = found.union(more.select("node.scan_id", F.col("node.id"), F.col("label.id")))
    # members of one wall stand together from here on
    members = shapes.join(found.hint("merge"), ["scan_id", "id"], "left").select("scan_id", F.coalesce("wall", "id").alias("wall"), *SHAPE).repartition("scan_id", "wall")
    by_wall = W.partitionBy("scan_id", "wall")
    # the direction of a group: the mean of doubled angles, so that directions on both sides of 0 agree
    turn = F.atan2(F.sum(F.sin(2 * F.col("dir"))).over(by_wall), F.sum(F.cos(2 * F.col("dir"))).over(by_wall)) / 2
    members = members.withColumn("dir", _direction()).withColumn("turn", turn).withColumns({"ux": F.cos("turn"), "uy": F.sin("turn")})
    along = lambda k: F.col(f"x{k}") * F.col("ux") + F.col(f"y{k}") * F.col("uy")
    n = ((F.col("y1") + F.col("y2")) * F.col("ux") - (F.col("x1") + F.col("x2")) * F.col("uy")) / 2
    at = members.withColumns({"t0": F.least(along(1), along(2)), "t1": F.greatest(along(1), along(2)), "n": n})
    top = F.max(F.col("z_base") + F.col("height"))
    deep = F.greatest(F.max("n") - F.min("n"), F.max("thickness")) if faces else F.max("thickness")
    by = at.groupBy("scan_id", "wall", "ux", "uy").agg(F.count(F.lit(1)).alias("n_fragments"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.avg("n").alias("n"), F.min("z_base").alias("z_base"), top.alias("top"), deep.alias("thickness"))
    end = lambda t: (F.col(t) * F.col("ux") - F.col("n") * F.col("uy"), F.col(t) * F.col("uy") + F.col("n") * F.col("ux"))
    (x1, y1), (x2, y2) = end("t0"), end("t1")
    return by.select("scan_id", F.col("wall").alias("id"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), "z_base", (F.col("top") - F.col("z_base")).alias("height"), "thickness", "n_fragments")


def joined_fragments(rows: DataFrame, offset: float = 0.20, gap: float = 0.8, height: float = 3.0, base_jump: float = 1.2) -> DataFrame:
    """A wall for each group of fragments on one line, in the groups' mean direction; id is the group's least."""
    return _walls(rows, lambda r: _collinear(r, offset, gap, height, base_jump, same=True), faces=False)


def joined_faces(rows: DataFrame, thickness: float = 0.40, overlap: float = 0.40) -> DataFrame:
    """A wall for each group of faces, midway between them and as thick as they are apart, if they are not thicker."""
    return _walls(rows, lambda r: _faces(r, thickness, overlap, same=True), faces=True)
