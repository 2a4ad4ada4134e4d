"""Operator 11: removal of long repeated spans by a compacted de Bruijn graph of word windows.

Edges are windows of WINDOW consecutive words. Only edges that may repeat are looked at: an edge's anchor is the least hash
of its runs of ANCHOR words, equal windows have equal anchors, and a document's anchors are a fifth of its words. Anchors
that several documents have (counted by one shuffle; an anchor that repeats within a block of texts is one row of it) go
back to their documents, which then give their edges with such anchors. Neighbouring edges of one anchor stand together as
one row, a link of a path, known by a hash of all its words.

Links are compacted to paths by joins. Per link, its first document and place is its source, and it branches where its
neighbours differ between documents or where a document leaves it; nonbranching neighbours in the source make a path, so
that every document that enters a path runs through all of it. Every occurrence of a link joins its path. Edges of links
that stand in one document only can still repeat, where a repeated passage begins or ends; those of anchors with several
links are joined edge by edge.

Spans of a document are then runs along a path with the coordinates of the source. Source and span are verified: texts are
shuffled once more, each gives a 128-bit BLAKE2 hash of the words of its own spans and of its paths, and each span's must
equal its source's. Hashes of words and links are 64 bits and their keys 128; should a span fail, everything is done
again with another seed.

A document's spans and paths are bounded by its length. A passage in a third of all documents is one row per block of texts
as an anchor, a partial aggregate as a link, and one path of its source; its occurrences are dealt by document.

Edge cases: null, empty and short texts lose nothing; a null doc_id is neither smaller nor larger than another, so such rows
stay whole and take nothing from others; rows of the same doc_id do not take from one another; equal rows get equal
results; windows that repeat within a document alone stay; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithos.llm.shared import scratch, stored, table
from lithos.llm.wordhash import blocks, mix

WINDOW = 13
ANCHOR = 6
#: Bytes of the texts that a task looks at together.
BLOCK_BYTES = 8_000_000
SEEDS = ("substring-spans-1", "substring-spans-2", "substring-spans-3")
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def seeded_words(texts: pa.Array, seed: str, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets of the texts); fewer bits make collisions, for tests."""
    pieces = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    coded = pieces.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    hashes = mix(pd.util.hash_array(words, hash_key=(seed * 16)[:16], categorize=False) >> np.uint64(64 - bits))
    which = coded.indices.to_numpy(zero_copy_only=False)
    full = (words != "")[which]
    return hashes[which[full]], np.concatenate(([0], np.cumsum(full)))[ends]


class Windows:
    """The windows of a block of texts: text (its number), at (place in the block), anchor; and hashes of word spans."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
        n = np.diff(offsets)
        each = np.maximum(n - window + 1, 0)
        self.text = np.repeat(np.arange(len(n)), each)
        self.at = np.arange(len(self.text)) + np.repeat(offsets[:-1] - (np.cumsum(each) - each), each)
        self.offsets = offsets
        power = np.multiply.accumulate(np.full(len(words) + 1, BASE, np.uint64))
        self.inverse = np.multiply.accumulate(np.full(len(words) + 1, INVERSE, np.uint64))
        self.upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)], dtype=np.uint64)))
        if len(self.at):
            runs = self.span(np.arange(len(words) - anchor + 1), anchor)
            least = np.lib.stride_tricks.sliding_window_view(runs, window - anchor + 1).min(1)
            self.anchor = least[self.at]
        else:
            self.anchor = np.zeros(0, np.uint64)

    def span(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the size words from each place on."""
        return mix((self.upto[at + size] - self.upto[at]) * self.inverse[at])


def named(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the row, which tells rows of one doc_id apart) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("t"), "text")


def shared_anchors(rows: DataFrame, window: int, anchor: int, seed: str, bits: int) -> DataFrame:
    """t, anchors: the anchors of a row that other rows have too.

    Within a block an anchor of several rows is known to be shared: its rows are sent under keys of their own, and the
    anchor once more for the other blocks.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES):
            w = Windows(*seeded_words(batch.column("text"), seed, bits), window, anchor)
            if not len(w.at):
                continue
            new = np.concatenate(([True], (w.anchor[1:] != w.anchor[:-1]) | (w.text[1:] != w.text[:-1])))
            a, text = w.anchor[new], w.text[new]
            order = np.lexsort((text, a))
            a, text = a[order], text[order]
            once = np.concatenate(([True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])))
            a, text = a[once], text[once]
            first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            many = np.diff(np.concatenate((first, [len(a)]))) > 1
            own = np.repeat(many, np.diff(np.concatenate((first, [len(a)]))))
            t = batch.column("t").to_numpy().view(np.uint64)[text]
            key = np.where(own, mix(a ^ mix(t)), a)
            more = a[first[many]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((key, more)).view(np.int64)),
                    pa.array(np.concatenate((t, more)).view(np.int64), mask=np.concatenate((np.zeros(len(t), bool), np.ones(len(more), bool)))),
                    pa.array(np.concatenate((a, more)).view(np.int64), mask=np.concatenate((~own, np.ones(len(more), bool)))),
                    pa.array(np.concatenate((np.where(own, 2, 1), np.full(len(more), 2))).astype(np.int8)),
                ],
                names=["key", "t", "a", "n"],
            )

    sent = rows.select("t", "text").mapInArrow(task, "key long, t long, a long, n byte")
    seen = sent.withColumn("all", F.sum("n").over(W.partitionBy("key"))).where("all > 1 AND t IS NOT NULL")
    return seen.select("t", F.coalesce("a", "key").alias("a")).groupBy("t").agg(F.collect_set("a").alias("anchors"))


def links(rows: DataFrame, shared: DataFrame, window: int, anchor: int, seed: str, bits: int) -> DataFrame:
    """a, c, doc_id, t, start, n, edges, left, right: runs of n edges of one shared anchor.

    (a, c) names a link by its anchor and its words; edges holds a 64-bit hash of each edge; left and right name the
    neighbours, or are 0 where the document has none.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES):
            w = Windows(*seeded_words(batch.column("text"), seed, bits), window, anchor)
            lists = batch.column("anchors").combine_chunks() if isinstance(batch.column("anchors"), pa.ChunkedArray) else batch.column("anchors")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            wanted = lists.flatten().to_numpy().view(np.uint64) ^ mix(np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64) + np.uint64(1))
            hit = np.flatnonzero(np.isin(w.anchor ^ mix(w.text.astype(np.uint64) + np.uint64(1)), wanted))
            if not len(hit):
                continue
            a, text, at = w.anchor[hit], w.text[hit], w.at[hit]
            beside = np.concatenate(([False], (text[1:] == text[:-1]) & (at[1:] == at[:-1] + 1)))
            head = np.flatnonzero(~beside | np.concatenate(([True], a[1:] != a[:-1])))
            n = np.diff(np.concatenate((head, [len(at)])))
            c = w.span(at[head], n + window - 1)
            name = mix(c ^ mix(a[head])) | np.uint64(1)
            joined = beside[head]  # to the link before
            left = np.where(joined, np.concatenate(([0], name[:-1])).astype(np.uint64), np.uint64(0))
            right = np.where(np.concatenate((joined[1:], [False])), np.concatenate((name[1:], [0])).astype(np.uint64), np.uint64(0))
            edge = w.span(at, window).astype("<u8")
            cut = np.concatenate((head, [len(at)])).astype(np.int32) * 8
            packed = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(edge.tobytes())])
            which = pa.array(text[head])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(a[head].view(np.int64)),
                    pa.array(c.view(np.int64)),
                    batch.column("doc_id").take(which),
                    batch.column("t").take(which),
                    pa.array(at[head] - w.offsets[text[head]]),
                    pa.array(n),
                    packed,
                    pa.array(left.view(np.int64)),
                    pa.array(right.view(np.int64)),
                ],
                names=["a", "c", "doc_id", "t", "start", "n", "edges", "left", "right"],
            )

    return rows.join(shared, "t").mapInArrow(task, "a long, c long, doc_id long, t long, start long, n long, edges binary, left long, right long")


def sources(found: DataFrame) -> DataFrame:
    """Per link: source (doc_id, t, start), n, edges, last (the largest doc_id) and whether its neighbours are always the same."""
    first = F.min(F.struct("doc_id", "t", "start", "n", "edges")).alias("source")
    same = lambda side: ((F.min(side) == F.max(side)) & (F.min(side) != 0)).alias(f"one_{side}")
    return found.groupBy("a", "c").agg(first, F.max("doc_id").alias("last"), same("left"), same("right")).select("a", "c", "source.*", "last", "one_left", "one_right")


def paths(links_: DataFrame) -> DataFrame:
    """Repeated links with path, the start of their path in the source: nonbranching neighbours share one."""
    inside = W.partitionBy("doc_id", "t").orderBy("start", "a", "c")
    goes_on = F.col("one_left") & F.lag("one_right").over(inside) & (F.lag(F.col("start") + F.col("n")).over(inside) == F.col("start"))
    rows = links_.where("last > doc_id").select("a", "c", "doc_id", "t", "start", "n", F.when(F.coalesce(goes_on, F.lit(False)), None).otherwise(F.col("start")).alias("begin"))
    path = F.last("begin", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("a", "c", "n", F.col("doc_id").alias("source"), F.col("t").alias("source_t"), F.col("start").alias("source_start"), path.alias("path"))


def edge_sources(links_: DataFrame) -> DataFrame:
    """a, c, skip, owner, source, source_t, source_start: edges of links' first documents that smaller documents have.

    Only anchors with several links can have such edges.
    """
    several = links_.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("k > 1 AND lo < hi").select("a")
    several = stored(several, "substring-several")  # as below
    edges = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.substring("edges", i * 8 + 1, F.lit(8)))
    rows = links_.join(several, "a").select("a", "c", "doc_id", "t", "start", F.posexplode(edges).alias("skip", "edge"))
    rows = stored(rows, "substring-edges")
    first = rows.groupBy("a", "edge").agg(F.min(F.struct("doc_id", "t", (F.col("start") + F.col("skip")).alias("at"))).alias("first"), F.max("doc_id").alias("last")).where("last > first.doc_id")
    first = stored(first, "substring-first")  # so that both sides of the join are shuffled and a hot edge can be split
    return rows.join(first, ["a", "edge"]).where("doc_id > first.doc_id").select("a", "c", "skip", F.col("doc_id").alias("owner"), F.col("first.doc_id").alias("source"), F.col("first.t").alias("source_t"), F.col("first.at").alias("source_start"))


def spans(found: DataFrame, links_: DataFrame) -> DataFrame:
    """doc_id, t, start, n, source, source_t, source_start: n edges of a document that its source has, along one path."""
    own = found.select("a", "c", "doc_id", "t", "start")
    whole = own.join(paths(links_), ["a", "c"]).where("doc_id > source").drop("a", "c")
    single = own.join(edge_sources(links_), ["a", "c"]).where("doc_id = owner")
    single = single.select("doc_id", "t", (F.col("start") + F.col("skip")).alias("start"), F.lit(1).cast("long").alias("n"), "source", "source_t", "source_start", F.lit(None).cast("long").alias("path"))
    rows = whole.select(single.columns).union(single)
    rows = rows.repartition("doc_id", "t").dropDuplicates()
    inside = W.partitionBy("doc_id", "t").orderBy("start")
    before = lambda c: F.lag(c).over(inside)
    same = (before("source") == F.col("source")) & (before("source_t") == F.col("source_t")) & (before("path") == F.col("path"))
    same &= (before(F.col("start") + F.col("n")) == F.col("start")) & (before(F.col("source_start") + F.col("n")) == F.col("source_start"))
    rows = rows.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("span", F.sum("new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "t", "span").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.first("source").alias("source"), F.first("source_t").alias("source_t"), F.min("source_start").alias("source_start")).drop("span")


def cleaned(rows: DataFrame, spans_: DataFrame, window: int, texts: bool) -> DataFrame:
    """doc rows: doc_id, n_words, n_removed, kept_sha256 and with texts the kept text; print rows: hashes of spans and sources."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES):
            docs, prints = [], []
            for doc_id, t, text, own, given in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "t", "text", "own", "given")), strict=True):
                w = (text or "").encode().split()
                words_of = lambda at, n: hashlib.blake2b(b" ".join(w[at : at + n + window - 1]), digest_size=16).digest()
                gone = np.zeros(len(w), bool)
                for s in own or ():
                    gone[s["start"] : s["start"] + s["n"] + window - 1] = True
                    prints.append((s["source"], s["source_t"], s["source_start"], s["n"], False, words_of(s["start"], s["n"])))
                prints += [(doc_id, t, s["start"], s["n"], True, words_of(s["start"], s["n"])) for s in given or ()]
                removed = int(gone.sum())
                body = b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g] if removed else w)
                docs.append((doc_id, len(w), removed, hashlib.sha256(body).hexdigest(), body.decode() if texts else None))
            one = lambda k, kind, rows, other: pa.array([r[k] for r in rows] + [None] * len(other), kind)
            two = lambda k, kind: pa.array([None] * len(docs) + [r[k] for r in prints], kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in docs] + [r[0] for r in prints], pa.int64()),
                    *(one(k, kind, docs, prints) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.string()))),
                    *(two(k, kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.bool_()), (5, pa.binary()))),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "text", "t", "start", "n", "is_source", "print"],
            )

    own = spans_.select("doc_id", "t", F.struct("start", "n", "source", "source_t", "source_start").alias("own"), F.lit(None).cast("struct<start:bigint,n:bigint>").alias("given"))
    given = spans_.select(F.col("source").alias("doc_id"), F.col("source_t").alias("t"), "source_start", "n").distinct()
    given = given.select("doc_id", "t", F.lit(None).cast(own.schema["own"].dataType).alias("own"), F.struct(F.col("source_start").alias("start"), "n").alias("given"))
    work = own.union(given).groupBy(F.col("doc_id").alias("d"), F.col("t").alias("u")).agg(F.collect_list("own").alias("own"), F.collect_list("given").alias("given"))
    joined = rows.join(work, (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("u")), "left").select("doc_id", "t", "text", "own", "given")
    return stored(joined.mapInArrow(task, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string, t long, start long, n long, is_source boolean, print binary"), "substring-cleaned", keep=True)


def verified(out: DataFrame) -> bool:
    """Whether every span has the words of its source."""
    prints = out.where("print IS NOT NULL").groupBy("doc_id", "t", "start", "n").agg(F.min("print").alias("lo"), F.max("print").alias("hi"), F.max("is_source").alias("known"))
    return prints.where("lo <> hi OR NOT known").isEmpty()


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = True, bits: tuple[int, ...] = (64, 64, 64)) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and with texts the kept words, joined by spaces, as text.

    bits are the bits of a word's hash at each attempt.
    """
    rows = named(docs)
    known = rows.where("doc_id IS NOT NULL")
    for seed, b in zip(SEEDS, bits, strict=False):
        with scratch(docs.sparkSession):
            with scratch(docs.sparkSession):
                with scratch(docs.sparkSession):
                    shared = stored(shared_anchors(known, window, anchor, seed, b), "substring-anchors")
                    found = stored(links(known, shared, window, anchor, seed, b), "substring-links", level=2)
                firsts = stored(sources(found), "substring-sources")
                repeated = stored(spans(found, firsts), "substring-spans", level=2)
            out = cleaned(rows, repeated, window, texts)
        if verified(out):
            out = out.where("kept_sha256 IS NOT NULL").select("doc_id", "n_words", "n_removed", "kept_sha256", "text")
            return out if texts else out.drop("text")
    raise RuntimeError("spans differ from their sources with every seed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT win, min(doc_id) AS least FROM e GROUP BY win),
g AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS j FROM e JOIN m USING (win) WHERE doc_id > least),
k AS (SELECT rid, list(j) AS gone FROM g GROUP BY rid),
x AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN k USING (rid))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(CASE WHEN len(gone) = 0 THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j]), ' ') END) AS kept_sha256
FROM x
"""
