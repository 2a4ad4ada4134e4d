"""Operator 5: mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. A source's documents are dealt into blocks by the key's first digits, so the
blocks are key ranges; sums over blocks, then over the rows of a block, give each document the number of words before
it in its source's random order. The cut at the source's budget needs only that number, and a budget beyond the source's
own words goes on into a second epoch. A source that holds a third of all rows is spread over all its blocks.

Edge cases: a null text or an empty one has size 0 and takes 0; null sources form one source, ordered last; a null
doc_id takes its key from the text; rows of one doc_id share a key and follow one another by size and text, each with its
own place; an empty table gives no rows; further columns go through mixed_documents packed, so their names cannot clash.

Windows over sources and over a source's blocks run in one task each: a row per source and at most 65,536 rows per source,
whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithos.llm.shared import n_words, stored, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Hexadecimal digits of the key that name a block: 65,536 key ranges for each source.
BLOCK_DIGITS = 4


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """sizes(source_key, source, size) -> one row per source with source_size and target.

    Targets fill up like water: level * weight, stopped at epochs * source_size. Sources sorted by the level at which
    they stop give the level from running sums; one row per source stands in these windows, never a document.
    """
    per = sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    cap = epochs * F.col("source_size")
    by_level = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("level", level).withColumn("open", F.when(cap / F.col("weight") > F.col("level"), F.col("level")))
    top = F.first("open", ignorenulls=True).over(every)
    return per.withColumn("target", F.coalesce(F.least(cap.cast("double"), top * F.col("weight")), cap.cast("double"))).select("source_key", "source_size", "target")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS, seed: str = "mix", carried: tuple[Column, ...] = ()) -> DataFrame:
    """One row per document: the carried columns, doc_id, source, size, source_size, target, taken."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit("")))))
    names = docs.select(*carried).columns
    sized = docs.select(*carried, "doc_id", "source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("source_key"), n_words(F.col("text")).alias("size"), F.md5(F.concat(F.lit(seed + ":"), ident)).alias("key"), F.xxhash64("text").alias("tie"))
    sized = stored(sized.withColumn("block", F.substring("key", 1, BLOCK_DIGITS)), "mix")
    block = W.partitionBy("source_key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = sized.groupBy("source_key", "block").agg(F.sum("size").alias("in_block")).select("source_key", "block", F.coalesce(F.sum("in_block").over(block), F.lit(0)).alias("before_block"))
    blocks = blocks.join(source_targets(sized, weights, share, epochs), "source_key")
    row = W.partitionBy("source_key", "block").orderBy("key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    out = sized.withColumn("in_order", F.coalesce(F.sum("size").over(row), F.lit(0))).join(blocks, ["source_key", "block"])
    at, budget = F.col("before_block") + F.col("in_order"), F.floor(F.col("target") + 0.5)
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), budget - e * F.col("source_size") - at)) for e in range(epochs)), F.lit(0))
    return out.select(*names, "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the mix takes, once per epoch, each row by its own place; a document at the cut goes in whole."""
    row = F.struct(*docs.columns).alias("carried_row")  # packed, so that no column of the documents can clash
    taken = mix(docs, carried=(row,), **how).where("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return taken.select("carried_row", F.explode(F.sequence(F.lit(1), copies))).select("carried_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '-' || md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
l AS (SELECT *, 2 * source_size / weight AS stops,
             (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2 * source_size) OVER b, 0)::DOUBLE)
             / ((sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER b, 0)::DOUBLE) AS level
      FROM w WINDOW b AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
top AS (SELECT min_by(level, (stops, coalesce(source, chr(1114111)))) AS level FROM l WHERE stops > level),
t AS (SELECT source, source_size, coalesce(least((2 * source_size)::DOUBLE, (SELECT level FROM top) * weight), (2 * source_size)::DOUBLE) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, budget - before)) + greatest(0, least(size, budget - source_size - before)))::BIGINT AS taken FROM p
"""
