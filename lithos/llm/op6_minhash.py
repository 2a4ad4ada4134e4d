"""Operator 6: near-duplicates by Order MinHash, verified by banded alignment.

Shingles are three words, labelled by their occurrence within the text. For each of SKETCHES hash functions the ORDER
smallest labelled shingles are kept in the order in which they stand in the text, so the sketch follows edit similarity
and not only the set of shingles. Short texts, of which a changed word takes many shingles, have further sketches of
pairs of words and of single words (FAMILIES). Texts that agree in a sketch are candidates; a candidate pair is linked if
the word sequences' edit similarity, 1 - distance / longer length, is at least SIMILARITY, as found by a banded alignment.

Equal texts are one node from the start. Classes are the connected components of the links, so a pair whose nodes are
already connected needs no alignment. Three passes find the components of all candidate pairs: each group of texts that
agree in one of the first FEW sketches against its smallest node; each group against its smallest node and every pair of
small groups; then, in larger groups that still hold several components, every node outside the group's commonest
component against all nodes of other components in the group. A pair of a group that no pass compares is connected, so
no candidate pair is left out. The last pass runs in cells of bounded size, where the exact number of words in common
rules out most pairs by one matrix product, a pair that meets in several groups is aligned in one of them, and only links
that join components leave the cell. Its matrix products grow with the nodes outside a group's commonest component times
the group; alignments only with pairs that share four fifths of their words and are not connected.

Recall: texts with shingle similarity J agree in one of m sketches with probability about 1 - (1 - J^2)^m; words replaced
at random at an edit similarity of 0.8 leave J = 0.34 and 0.98 for m = 32. Texts below three words have one shingle of all
their words.

Edge cases: null and empty texts are equal texts of one class; white-space variants of an empty text have no words and
stay alone; repeated rows and equal doc_ids keep their own rows; a class whose ids are all null has a null class_id;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm.components import components
from lithos.llm.shared import scratch, stored, table
from lithos.llm.wordhash import banded_distance, mix, word_hashes

SHINGLE = 3
SKETCHES = 32
ORDER = 2
#: (longest text in words, words a shingle, sketches, order): the first for all texts, further ones for short texts.
FAMILIES = [(None, SHINGLE, SKETCHES, ORDER), (64, 2, 16, 2), (24, 1, 16, 2)]
SIMILARITY = 0.8
#: Groups up to this size compare every pair.
SMALL = 6
#: Sketches of the first pass, which connects most of the large families.
FEW = 4
#: Nodes and words of one side of a cell of the last pass, and words of one matrix in it.
CELL_NODES = 512
CELL_WORDS = 1 << 20
MATRIX_WORDS = 1 << 14
BLOCK_WORDS = 200_000


def _labelled(words: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the occurrence-labelled shingles of all texts, offsets)."""
    n = np.diff(offsets)
    each = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    upto = np.concatenate(([0], np.cumsum(each)))
    if not upto[-1]:
        return np.zeros(0, np.uint64), upto
    at = np.arange(upto[-1]) + np.repeat(offsets[:-1] - upto[:-1], each)
    last = np.repeat(offsets[1:], each)
    h = np.zeros(len(at), np.uint64)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    for j in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(at + j < last, padded[at + j], np.uint64(0)))
    doc = np.repeat(np.arange(len(n)), each)
    own = h ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.sort(own)
    if len(twice := np.unique(order[1:][order[1:] == order[:-1]])):
        i = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
        rows = np.flatnonzero(twice[i] == own)
        rows = rows[np.argsort(own[rows], kind="stable")]
        head = np.concatenate(([True], own[rows][1:] != own[rows][:-1]))
        nth = np.arange(len(rows)) - np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))
        h[rows] = mix(h[rows] + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, upto


def sketches(words: np.ndarray, offsets: np.ndarray, m: int = SKETCHES, order: int = ORDER, k: int = SHINGLE, first: int = 0) -> np.ndarray:
    """(texts, m) keys of the hash functions from first on; texts without words get rows of zeros that nobody reads."""
    h, upto = _labelled(words, offsets, k)
    n = np.diff(upto)
    out = np.zeros((len(n), m), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    start, size = upto[:-1][some], n[some]
    bits = max(1, int(size.max()).bit_length())
    place = (np.arange(len(h)) - np.repeat(start, size)).astype(np.uint64)
    high, low = np.uint64(~((1 << bits) - 1) & 0xFFFFFFFFFFFFFFFF), np.uint64((1 << bits) - 1)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for column, j in enumerate(range(first, first + m)):
        v = mix((h ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x2545F4914F6CDD1D)) & high | place
        picked = np.full((len(some), order), len(h), np.int64)
        for i in range(order):
            least = np.minimum.reduceat(v, start)
            has = size > i
            picked[has, i] = start[has] + (least[has] & low).astype(np.int64)
            v[picked[has, i]] = top
        picked.sort(axis=1)
        got = np.concatenate((h, [np.uint64(0)]))[picked]
        key = np.full(len(some), np.uint64(j + 1))
        for i in range(order):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + got[:, i])
        out[some, column] = key
    return out


def all_sketches(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all families, offsets of the texts); the first family's stand first."""
    n = np.diff(offsets)
    parts, owner, first = [], [], 0
    for longest, k, m, order in FAMILIES:
        rows = np.arange(len(n)) if longest is None else np.flatnonzero((n > 0) & (n <= longest))
        size = n[rows]
        upto = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(upto[-1]) + np.repeat(offsets[:-1][rows] - upto[:-1], size)
        parts.append(sketches(words[at], upto, m, order, k, first).reshape(-1))
        owner.append(np.repeat(rows, m))
        first += m
    who = np.concatenate(owner)
    return np.concatenate(parts)[np.argsort(who, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(n)))))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, node (MD5 of the text), n (words) and keys of each document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = word_hashes(batch.column("text"))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_WORDS, "right")) - 1)
                keys, upto = all_sketches(words[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                flat = pa.array(keys.view(np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "node")), pa.array(np.diff(offsets[lo : hi + 1]).astype(np.int64)), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), flat)], names=["doc_id", "node", "n", "keys"])
                lo = hi

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("node"), text.alias("text")).mapInArrow(task, "doc_id long, node string, n long, keys array<long>")


def grouped(members: DataFrame) -> DataFrame:
    """members(place, key, node, n) -> the members of groups of two or more, with size and leader (the smallest node).

    Size and leader are partial aggregates, and only they are joined with the members.
    """
    groups = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n")).alias("least")).where("size > 1")
    inside = members.join(groups, "key").select("place", "key", "node", "n", "size", F.col("least.node").alias("leader"), F.col("least.n").alias("leader_n"))
    return stored(inside, "groups")


def _close(pairs: DataFrame) -> DataFrame:
    """The distinct pairs whose lengths alone do not rule out the similarity."""
    close = F.abs(F.col("an") - F.col("bn")) <= F.lit(1 - SIMILARITY + 1e-9) * F.greatest("an", "bn")
    return pairs.where(close & (F.least("an", "bn") > 0)).select("a", "b").distinct()


def star_pairs(inside: DataFrame) -> DataFrame:
    """an, bn, a, b: each member with its group's leader."""
    return inside.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"), F.col("leader_n").alias("an"), F.col("n").alias("bn"))


def small_pairs(inside: DataFrame) -> DataFrame:
    """an, bn, a, b: the pairs of small groups without their leaders."""
    small = inside.where(f"size BETWEEN 3 AND {SMALL} AND node <> leader")
    rest = small.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("all"))  # at most SMALL - 1
    rest = rest.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).where("x.node < y.node")
    return rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("an"), F.col("y.n").alias("bn"))


def unconnected(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are not in one component yet."""
    label = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}l"))
    both = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return both.where(F.coalesce("al", "a") != F.coalesce("bl", "b")).select("a", "b")


def divided(inside: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, n, comp, hub, one_cell: members of large groups of several components; groups of the same members once.

    hub is the component with the most members; one_cell tells whether the whole group fits into a cell.
    """
    large = inside.where(f"size > {SMALL}").select("key", "node", "n").join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("comp"))
    parts = large.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.expr("bit_xor(xxhash64(node))").alias("x"))
    groups = parts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("most"), F.sum("c").alias("size"), F.sum("w").alias("words"), F.expr("bit_xor(x)").alias("x"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    once = groups.groupBy("size", "x").agg(F.min(F.struct("key", F.col("most.comp").alias("hub"), ((F.col("size") <= CELL_NODES) & (F.col("words") <= CELL_WORDS)).alias("one_cell"))).alias("g")).select("g.*")
    return stored(large.join(once, "key"), "divided")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(len(a), len(b)): how many words two texts have in common, each counted as often as both have it."""

    def counted(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        # a word's second occurrence in a text is another word than its first
        words, rows = np.concatenate(texts).astype(np.uint64), np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        order = np.lexsort((words, rows))
        words, rows = words[order], rows[order]
        at = np.arange(len(words))
        head = np.concatenate(([True], (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])))
        nth = at - np.maximum.accumulate(np.where(head, at, 0))
        return words << np.uint64(32) | nth.astype(np.uint64), rows

    (aw, ar), (bw, br) = counted(a), counted(b)
    both = np.unique(aw)
    at = np.minimum(np.searchsorted(both, bw), len(both) - 1)
    both = np.unique(both[at[both[at] == bw]])
    out = np.zeros((len(a), len(b)), np.float32)
    for words in np.array_split(both, max(1, -(-len(both) // MATRIX_WORDS))):
        if len(words):
            sides = []
            for w, r, n in ((aw, ar, len(a)), (bw, br, len(b))):
                at = np.minimum(np.searchsorted(words, w), len(words) - 1)
                hit = words[at] == w
                side = np.zeros((n, len(words)), np.float32)
                side[r[hit], at[hit]] = 1
                sides.append(side)
            out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def cell_links(left: list[tuple], right: list[tuple], key: int) -> list[tuple[str, str]]:
    """Links that join the components of left and right, as few as do, of a group's key.

    Both sides are tuples of node, component, words, the keys of the node's groups and whether it is outside the hub.
    Every pair of different components is compared unless a bound rules it out, a link found before has joined it, or it
    is compared elsewhere: in the group of the least key that both nodes have, or from the other side.
    """
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    an, bn = (np.array([len(x[2]) for x in side]) for side in (left, right))
    longer = np.maximum(an[:, None], bn[None, :])
    most = ((1 - SIMILARITY) * longer + 1e-9).astype(np.int64)
    least = longer - overlaps([x[2] for x in left], [x[2] for x in right])  # words that the other text lacks must each be edited
    out = []
    for i, (u, uc, x, ukeys, _) in enumerate(left):
        near = np.flatnonzero(least[i] <= most[i])
        for j in near[np.argsort(least[i][near], kind="stable")].tolist():
            v, vc, y, vkeys, outside = right[j]
            if outside and v < u or (p := find(uc)) == (q := find(vc)) or min(ukeys & vkeys) != key:
                continue
            if banded_distance(x.tolist(), y.tolist(), int(most[i, j])) <= most[i, j]:
                parent[p] = q
                out.append((u, v))
    return out


def cell_pairs(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """divided rows -> a, b: links that join the components of every group.

    The nodes outside a group's hub meet all its nodes of similar length in cells of about CELL_NODES nodes and CELL_WORDS
    words a side; a cell returns fewer links than it has components, however many of its pairs are similar.
    """
    # similar lengths are one band apart at most
    rows = rows.withColumn("band", F.when(F.col("one_cell"), 0).otherwise(F.floor(F.log(F.col("n")) / F.log(F.lit(1.26)))))
    left, right = rows.where("comp <> hub").withColumnRenamed("band", "lband"), rows.withColumnRenamed("band", "rband")
    cuts = lambda name: F.greatest(F.ceil(F.count(F.lit(1)) / CELL_NODES), F.ceil(F.sum("n") / CELL_WORDS)).alias(name)
    lefts = left.groupBy("key", "lband").agg(cuts("parts")).withColumn("rband", F.explode(F.array(F.col("lband") - 1, F.col("lband"), F.col("lband") + 1)))
    grid = stored(lefts.join(right.groupBy("key", "rband").agg(cuts("blocks")), ["key", "rband"]), "grid")
    deal, upto = F.xxhash64("node"), lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    cell = ["key", "lband", "rband", "part", "block"]
    left = left.join(grid, ["key", "lband"]).withColumn("part", F.pmod(deal, F.col("parts"))).withColumn("block", upto("blocks"))
    right = right.join(grid, ["key", "rband"]).withColumn("block", F.pmod(deal, F.col("blocks"))).withColumn("part", upto("parts"))
    keys = rows.groupBy("node").agg(F.collect_list("key").alias("keys"))  # at most a key of each sketch
    words = stored(texts.select("node", "words").join(keys, "node"), "words")
    sides = [x.select(*cell, "node", "comp", (F.col("comp") != F.col("hub")).alias("outside")).join(words, "node").toDF("node", *cell, "comp", "outside", "words", "keys") for x in (left, right)]

    def task(a: pa.Table, b: pa.Table) -> pa.Table:
        side = lambda t: [(u, c, np.frombuffer(w, np.uint32), frozenset(k), o) for u, c, w, k, o in zip(*(t.column(x).to_pylist() for x in ("node", "comp", "words", "keys", "outside")), strict=True)]
        found = cell_links(side(a), side(b), a.column("key")[0].as_py()) if a.num_rows and b.num_rows else []
        return pa.table({"a": pa.array([min(x) for x in found], pa.string()), "b": pa.array([max(x) for x in found], pa.string())})

    return sides[0].groupBy(*cell).cogroup(sides[1].groupBy(*cell)).applyInArrow(task, "a string, b string")


def tokens(docs: DataFrame) -> DataFrame:
    """node and words (32-bit word hashes) of texts(node, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = word_hashes(batch.column("text"))
            low = words.astype(np.uint32)
            parts = [low[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(parts, pa.binary())], names=["node", "words"])

    return docs.mapInArrow(task, "node string, words binary")


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two word sequences reach the edit similarity."""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    # words of one text that the other lacks must each be edited
    both, sign = np.concatenate((a, b)), np.concatenate((np.ones(len(a), np.int64), -np.ones(len(b), np.int64)))
    order = np.argsort(both, kind="stable")
    both, sign = both[order], sign[order]
    head = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    left = np.add.reduceat(sign, head) if len(head) else sign
    if max(int(left[left > 0].sum()), int(-left[left < 0].sum())) > most:
        return False
    return banded_distance(a.tolist(), b.tolist(), most) <= most


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) that the banded alignment confirms."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            ok = [similar(np.frombuffer(x[i].as_py(), np.uint32), np.frombuffer(y[i].as_py(), np.uint32), similarity) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_x = pairs.join(texts.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
    return with_x.join(texts.select(F.col("node").alias("a"), F.col("words").alias("x")), "a").select("a", "b", "x", "y").mapInArrow(task, "a string, b string")


def connected(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, label: the components of all candidate pairs of the documents, whose sketches are rows, that are similar."""
    nodes = stored(rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
    inside = grouped(nodes.select("node", "n", F.posexplode("keys").alias("place", "key")))
    # the words of all texts that any group holds; copies meet before the shuffle, and texts are shuffled this once
    text = F.coalesce("text", F.lit(""))
    once = docs.select(F.md5(text).alias("node"), text.alias("text")).groupBy("node").agg(F.first("text").alias("text"))
    texts = stored(tokens(once.join(inside.select("node").distinct(), "node", "left_semi")), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        return stored(verified(pairs, texts), "verified")

    found = linked(_close(star_pairs(inside.where(F.col("place") < FEW))))
    labels = components(found)
    found = found.union(linked(unconnected(_close(star_pairs(inside).union(small_pairs(inside))), labels)))
    labels = components(found)
    rest = divided(inside, labels)
    if rest.isEmpty():
        return labels
    return components(found.union(stored(cell_pairs(rest, texts), "cells")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the class's smallest doc_id), class_size, n_words and the class itself, of every document."""
    with scratch(docs.sparkSession):
        rows = stored(sketched(docs), "sketches")
        labels = connected(docs, rows)
        named = rows.select("doc_id", "node", "n").join(labels, "node", "left").select("doc_id", F.col("n").alias("n_words"), "node", F.coalesce("label", "node").alias("class"))
        named = stored(named, "classed", keep=True)
    # most classes have one row, whose figures need no join; the others' are written first, so that a large class can be split
    many = stored(named.groupBy(F.col("class").alias("_class")).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1"), "classes")
    out = named.join(many, named["class"] == many["_class"], "left")
    return out.select("doc_id", F.when(F.col("_class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "n_words", "node", "class")


def first_documents(docs: DataFrame) -> DataFrame:
    """One row of each class: of the rows with its smallest doc_id the one with the least MD5 of the text, and of those the
    one with the least hash of all columns. Rows that are equal in every column are interchangeable."""
    classes = near_duplicates(docs)
    keep = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "node", "class", (F.col("class_size") > 1).alias("many")).distinct()
    row = F.struct(*docs.columns).alias("row")  # packed, so that no column of the documents can clash
    rows = docs.select(row, F.col("doc_id").cast("long").alias("row_id"), F.md5(F.coalesce("text", F.lit(""))).alias("row_node"), F.xxhash64(*docs.columns).alias("hash"))
    kept = rows.join(keep, (F.col("row_node") == F.col("node")) & F.col("row_id").eqNullSafe(F.col("doc_id"))).select("row", "class", "many", F.struct("node", "hash").alias("order"))
    once = kept.where("NOT many").select("row")
    return once.union(kept.where("many").groupBy("class").agg(F.min_by("row", "order").alias("row")).select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_words")
