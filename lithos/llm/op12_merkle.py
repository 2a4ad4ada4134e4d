"""Operator 12: a Merkle manifest of a dataset, persisted every few levels, with recomputed proofs.

Every row is a leaf, the SHA-256 of its fields. Within a source, leaves in order of doc_id form a tree: FANOUT consecutive
nodes become one, level by level, until one is left, the source's subroot; the subroots form a tree of the same kind, whose
root stands for the dataset. Only every STEP-th level is stored (the checkpoints). An aligned subtree is the FANOUT ** STEP
nodes of a stored level below one node of the next: building hashes it up and keeps its top; a proof hashes it again from
the stored nodes, takes the siblings of every node in it, and drops the rest. The proofs of a level are the siblings within
the subtree followed by the proof of the subtree's top, so each level is one join whose upper side is FANOUT ** STEP times
smaller, and no group holds more than that many nodes.

Leaves get their place in a source by a range sort and sums over its partitions, so that a source may hold any share of
the rows: no group or window holds a whole source, only a row for each of its partitions.

Edge cases: null fields are written as "-"; a null doc_id comes first in its source and is never tampered with; rows of the
same doc_id are ordered by their leaf and equal rows are leaves of their own; a null source is a source of its own, the
first; a source of one row has its leaf as subroot, and a lone source's subroot is the root; a leaf without siblings has
the hash of nothing as proof_sha256; texts may be empty or long; extra columns are ignored; an empty table has no rows and
no root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithos.llm.shared import stored, table

FANOUT = 3
#: Levels from one stored level to the next.
STEP = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A field as the leaf hashes it: its length in bytes and its value, or "-"."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return sha(F.concat(*(encoded(fields[c]) for c in FIELDS)))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without line ends where 2 divides the CRC-32 of the decimal doc_id."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, digest, tampered: a row's leaf and the leaf of its tampered text. A tree's name sorts null first."""
    fields = {c: F.col(c) for c in FIELDS}
    changed = fields | {"text": tampered_text(F.col("doc_id"), F.col("text"))}
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(fields).alias("digest"), leaf(changed).alias("tampered"))


def numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """nodes with i, their place within their tree in the given order, and n, the size of the tree."""
    keys = [F.col("tree"), *order]
    dealt = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()), "merkle-sorted")
    dealt = dealt.withColumn("k", F.row_number().over(W.partitionBy("tree", "part").orderBy(*order)) - 1)
    sizes = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"))
    upto = W.partitionBy("tree").orderBy("part")
    sizes = sizes.select(
        "tree",
        "part",
        F.coalesce(F.sum("c").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("c").over(upto.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"),
    )
    return dealt.join(sizes, ["tree", "part"]).withColumn("i", (F.col("before") + F.col("k")).cast("long")).drop("part", "k", "before")


def subtrees(level: DataFrame) -> DataFrame:
    """tree, up, n, kids: the stored nodes below each node of the next stored level, in order."""
    payload = [c for c in level.columns if c not in ("tree", "n")]
    kids = F.sort_array(F.collect_list(F.struct("i", *(c for c in payload if c != "i"))))  # at most FANOUT ** STEP
    return level.groupBy("tree", F.expr(f"i div {FANOUT**STEP}").alias("up")).agg(F.max("n").alias("n"), kids.alias("kids"))


def hashed(nodes: Column) -> Column:
    """The nodes above an aligned row of nodes."""
    at = F.sequence(F.lit(0), F.ceil(F.size(nodes) / FANOUT).cast("int") - 1)
    return F.transform(at, lambda j: sha(F.array_join(F.slice(nodes, j * FANOUT + 1, FANOUT), "")))


def with_interior(groups: DataFrame) -> DataFrame:
    """groups with l0 to lSTEP, the levels of each subtree; levels above the tree's top are null."""
    out = groups.withColumn("l0", F.col("kids.digest"))
    for s in range(STEP):
        out = out.withColumn(f"l{s + 1}", F.when(F.col("n") > FANOUT**s, hashed(F.col(f"l{s}"))))
    return out


def next_level(level: DataFrame) -> DataFrame:
    """The tops of the subtrees of a stored level: tree, i, n, digest."""
    top = F.coalesce(*(F.col(f"l{s}") for s in range(STEP, -1, -1)))
    n = F.ceil(F.col("n") / FANOUT**STEP).cast("long")
    return with_interior(subtrees(level.select("tree", "i", "n", "digest"))).select("tree", F.col("up").alias("i"), n.alias("n"), F.element_at(top, 1).alias("digest"))


@dataclass
class Tree:
    """The stored levels, leaves first; the last has one node for each tree."""

    levels: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        return self.levels[-1].select("tree", "digest")


def build(nodes: DataFrame, order: list[Column]) -> Tree:
    levels = [stored(numbered(nodes, order), "merkle-0")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(stored(next_level(levels[-1]), f"merkle-{STEP * len(levels)}"))
        most = -(-most // FANOUT**STEP)
    return Tree(levels)


def siblings(nodes: Column, at: Column) -> Column:
    """The run's nodes before and after the one at a place, each joined."""
    own = at % FANOUT
    left, right = F.slice(nodes, at - own + 1, own), F.slice(nodes, at + 2, FANOUT - 1 - own)
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """The leaves' columns with proof, the siblings from leaf to root, and top, the tree's root.

    above gives each tree's proof beyond its root: tree, proof (array of left, right).
    """
    out = tree.levels[-1].join(above, "tree").withColumn("top", F.col("digest"))
    for level in reversed(tree.levels[:-1]):
        upper = out.select("tree", F.col("i").alias("up"), "proof", "top")
        groups = with_interior(subtrees(level)).join(upper, ["tree", "up"])
        nodes = groups.select("*", F.posexplode("kids").alias("at", "kid"))
        own = F.array_compact(F.array(*(F.when(F.col(f"l{s + 1}").isNotNull(), siblings(F.col(f"l{s}"), F.expr(f"at div {FANOUT**s}"))) for s in range(STEP))))
        out = nodes.select("tree", "kid.*", F.concat(own, "proof").alias("proof"), "top")
    return out


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, digest, lambda acc, x: sha(F.concat(x["left"], acc, x["right"])))


def manifest(docs: DataFrame) -> tuple[Tree, Tree]:
    """The trees of the sources and the tree of their subroots, both stored."""
    sources = build(stored(leaves(docs), "merkle-leaves"), [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    subroots = sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    return sources, build(subroots, [F.col("source")])


def verified(sources: Tree, top: Tree) -> DataFrame:
    """Per row: its proof and what folding its tampered leaf gives."""
    none = F.array().cast("array<struct<left:string,right:string>>")
    single = top.levels[-1].select("tree").withColumn("proof", none)
    roots = proofs(top, single).select(F.col("source").alias("tree"), "proof", F.col("top").alias("root"))
    root = (top.roots.first() or [None, None])[1]  # one digest
    rows = proofs(sources, roots.drop("root"))
    siblings_of = F.array_join(F.transform("proof", lambda x: F.concat(x["left"], x["right"])), "")
    rows = rows.select("doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"), sha(siblings_of).alias("proof_sha256"), folded(F.col("tampered"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(*manifest(table(spark, sf_dir, "documents")))


_CRC = "xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))))"


def _enc(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


_FIXED = " || ".join(_enc(c) for c in FIELDS[:-1])
_UP = "list_transform(range(0, (len(nodes) + 2) // 3), lambda j: sha256(array_to_string(nodes[3 * j + 1:3 * j + 3], '')))"
SQL = f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, sha256({_FIXED} || {_enc("text")}) AS leaf,
    CASE WHEN {_CRC} % 2 = 0 THEN sha256({_FIXED} || {_enc("replace(text, chr(10), '')")}) ELSE sha256({_FIXED} || {_enc("text")}) END AS tampered
  FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS rid FROM raw),
s(tree, lvl, nodes) AS (
  SELECT tree, 0, list(leaf ORDER BY i) FROM d GROUP BY tree
  UNION ALL SELECT tree, lvl + 1, {_UP} FROM s WHERE len(nodes) > 1),
sub AS (SELECT tree, nodes[1] AS subroot, lvl AS height FROM s WHERE len(nodes) = 1),
t(lvl, nodes) AS (
  SELECT 0, list(subroot ORDER BY encode(tree)) FROM sub
  UNION ALL SELECT lvl + 1, {_UP} FROM t WHERE len(nodes) > 1),
top AS (SELECT nodes[1] AS root, lvl AS height FROM t WHERE len(nodes) = 1),
ranked AS (SELECT tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS rank FROM sub),
f(rid, lvl, acc, sib) AS (
  SELECT rid, 0, tampered, '' FROM d
  UNION ALL
  SELECT f.rid, f.lvl + 1, sha256(array_to_string(l.nodes[p - p % 3 + 1:p], '') || acc || array_to_string(l.nodes[p + 2:p - p % 3 + 3], '')),
    sib || array_to_string(l.nodes[p - p % 3 + 1:p], '') || array_to_string(l.nodes[p + 2:p - p % 3 + 3], '')
  FROM f JOIN d USING (rid) JOIN sub ON sub.tree = d.tree JOIN ranked ON ranked.tree = d.tree CROSS JOIN top
  JOIN (SELECT tree, lvl, nodes FROM s UNION ALL SELECT NULL, lvl, nodes FROM t) l
    ON (f.lvl < sub.height AND l.tree = d.tree AND l.lvl = f.lvl) OR (f.lvl >= sub.height AND l.tree IS NULL AND l.lvl = f.lvl - sub.height)
  CROSS JOIN LATERAL (SELECT CASE WHEN f.lvl < sub.height THEN i // (3 ** f.lvl)::BIGINT ELSE rank // (3 ** (f.lvl - sub.height))::BIGINT END AS p)
  WHERE f.lvl < sub.height + top.height)
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM d JOIN sub USING (tree) CROSS JOIN top JOIN f USING (rid) WHERE f.lvl = sub.height + top.height
"""
