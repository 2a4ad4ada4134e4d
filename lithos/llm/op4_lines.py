"""Operator 4: line dedup by a sharded minimal perfect hash.

Documents are dealt into buckets of about BUCKET_DOCS. For each bucket and distinct line key one small row (128-bit hash,
number of documents) leaves the scan. These rows are dealt by hash into shards of about SHARD_KEYS keys. A shard's
distinct keys get a minimal perfect hash (levels of bitmaps, ranks by popcount) that indexes a fingerprint array and a
count array; this index is a table of its own. The buckets' keys probe it, the keys that are too frequent go back to
their buckets, and there the lines go. Texts are shuffled once and lines never. A line that every document holds is one
row per bucket in its shard.

Edge cases: a null or empty text is one empty line; lines without a key (white space only) stay; a line that repeats in a
document counts once for it; a document that loses all lines keeps the empty text; rows with a null or repeated doc_id
are documents of their own; very long lines are hashed like any other; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm.shared import stored, table

MIN_DOCS = 10
MIN_KEY = 1
BUCKET_DOCS = 256
SHARD_KEYS = 32_768
GAMMA = 1.5
#: A shard with more than so many times the usual rows is probed in several parts.
HOT = 4
ROWS = 500
STRIP = b" \t\n\x0b\x0c\r"


def _keys(text: bytes, min_key: int) -> list[tuple[bytes, bytes]]:
    """(line, 16-byte hash of its key or b"" where it has none) for every line."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(STRIP).lower()
        # a code point starts with a byte that is no continuation byte
        short = len(key) < 4 * min_key and len(key.decode("utf-8", "replace")) < min_key
        out.append((line, b"" if short else xxhash.xxh3_128_digest(key)))
    return out


def _mix(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    x = (a ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) + b * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: at each level, keys alone at their bit are placed by its rank."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ranks = [np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in levels]
        base = np.cumsum([0] + [int(r[-1]) for r in ranks])
        self.ranks = [r + int(b) for r, b in zip(ranks, base, strict=False)]

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels = []
        while len(a):
            size = max(8, int(GAMMA * len(a)))
            at = (_mix(a, b, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            levels.append(np.bincount(at, minlength=size) == 1)
            rest = ~levels[-1][at]
            a, b = a[rest], b[rest]
        return cls(levels)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Positions; -1 for a key that is surely not in the set."""
        out, open_ = np.full(len(a), -1, np.int64), np.arange(len(a))
        for i, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (_mix(a[open_], b[open_], i + 1) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def to_bytes(self) -> tuple[list[int], bytes]:
        return [len(x) for x in self.levels], b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, sizes: list[int], data: bytes) -> PerfectHash:
        levels, at = [], 0
        for n in sizes:
            k = (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, k, at), count=n).astype(bool))
            at += k
        return cls(levels)


def bucketed(docs: DataFrame, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """doc_id, text and the bucket that a document belongs to."""
    n = max(1, -(-docs.count() // bucket_docs))
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("bucket"))


def line_counts(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """bucket, a, b, n: in how many documents of the bucket the key with hash (a, b) stands."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist()
            found = [{h for _, h in _keys(t, min_key) if h} for t in texts]
            each = np.fromiter(map(len, found), np.int64, len(found))
            h = np.frombuffer(b"".join(x for s in found for x in s), "<u8").reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"bucket": np.repeat(batch.column("bucket").to_numpy(), each), "a": h[:, 0].astype(np.int64), "b": h[:, 1].astype(np.int64)})

    return docs.select("bucket", "text").mapInArrow(task, "bucket long, a long, b long").groupBy("bucket", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def sharded(keys: DataFrame, n_shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.xxhash64("a", "b"), F.lit(n_shards)))


def build_index(counts: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard: sizes and bits of the perfect hash, the fingerprint array and the count array."""

    def shard(t: pa.Table) -> pa.Table:
        a, b = (t.column(c).to_numpy().view(np.uint64) for c in "ab")
        ph = PerfectHash.build(a, b)
        at = ph(a, b)
        prints, count = np.empty(len(a), "<u4"), np.empty(len(a), "<u4")
        prints[at], count[at] = (b >> np.uint64(32)).astype(np.uint32), np.minimum(t.column("n").to_numpy(), 2**32 - 1)
        sizes, bits = ph.to_bytes()
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": [bits], "prints": [prints.tobytes()], "counts": [count.tobytes()]})

    keys = counts.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return sharded(keys, n_shards).groupBy("shard").applyInArrow(shard, "shard long, sizes array<long>, bits binary, prints binary, counts binary")


def probe(counts: DataFrame, index: DataFrame, n_shards: int, shard_keys: int = SHARD_KEYS, min_docs: int = MIN_DOCS) -> DataFrame:
    """bucket, a, b of the buckets' keys that the index counts in at least min_docs documents.

    A shard that a very common line swells is probed in several parts, each with its own copy of the shard's arrays.
    """

    def shard(keys: pa.Table, arrays: pa.Table) -> pa.Table:
        a, b = (keys.column(c).to_numpy().view(np.uint64) for c in "ab")
        keep = np.zeros(len(a), bool)
        if arrays.num_rows and len(a):
            x = arrays.to_pylist()[0]
            prints, count = np.frombuffer(x["prints"], "<u4"), np.frombuffer(x["counts"], "<u4")
            at = PerfectHash.from_bytes(x["sizes"], x["bits"])(a, b)
            keep = (at >= 0) & (prints[at] == (b >> np.uint64(32)).astype(np.uint32)) & (count[at] >= min_docs)
        return keys.select(["bucket", "a", "b"]).filter(pa.array(keep))

    keys = sharded(counts.select("bucket", "a", "b"), n_shards)
    parts = keys.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (HOT * shard_keys)).cast("int").alias("parts"))
    keys = keys.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("bucket"), F.col("parts"))).drop("parts")
    index = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).drop("parts")
    return keys.groupBy("shard", "part").cogroup(index.groupBy("shard", "part")).applyInArrow(shard, "bucket long, a long, b long")


def drop_lines(docs: DataFrame, hits: DataFrame, min_key: int = MIN_KEY, texts: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, the SHA-256 of the text without the lines that hit, and with texts that text.

    A bucket's hits come before its documents in one sorted stream, so a task holds the hits of one bucket.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gone = None, set()
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            bodies = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist()
            buckets, is_doc = batch.column("bucket").to_pylist(), batch.column("is_doc").to_pylist()
            hashes = np.stack([pc.fill_null(batch.column(c), 0).to_numpy() for c in "ab"], 1)
            rows = []
            for i, text in enumerate(bodies):
                if buckets[i] != at:
                    at, gone = buckets[i], set()
                if not is_doc[i]:
                    gone.add(hashes[i].tobytes())
                    continue
                lines = _keys(text, min_key)
                kept = [x for x, h in lines if h not in gone]
                body = b"\n".join(kept)
                rows.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(body).hexdigest(), body.decode("utf-8", "replace") if texts else None))
            i, n, dropped, sha, text = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(i, pa.int64())), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "text"])

    docs = docs.select("bucket", F.lit(True).alias("is_doc"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    hits = hits.select("bucket", F.lit(False).alias("is_doc"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "a", "b")
    stream = docs.unionByName(hits).repartition("bucket").sortWithinPartitions("bucket", "is_doc")
    out = stream.mapInArrow(task, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, text string")
    return out if texts else out.drop("text")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_key: int = MIN_KEY, shard_keys: int = SHARD_KEYS, texts: bool = True) -> DataFrame:
    docs = bucketed(docs)
    counts = stored(line_counts(docs, min_key), "line-counts")
    n_shards = max(1, -(-counts.count() // shard_keys))
    index = stored(build_index(counts, n_shards), "line-index")
    return drop_lines(docs, probe(counts, index, n_shards, shard_keys, min_docs), min_key, texts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), texts=False)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, ls[i] AS line, i, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT key, count(DISTINCT rid) >= 10 AND len(key) >= 1 AS gone FROM l GROUP BY key),
j AS (SELECT rid, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
      FROM l JOIN k USING (key) GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM j JOIN d USING (rid)
"""
