"""Operator 9: benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

An item and a window of a document are sequences of lower-cased words. The CGK embedding walks along a sequence: it
emits the word it stands on and moves on or stays by a random bit of step and word, so an edit puts two walks out of
step only until chance brings them together, and edit distance becomes Hamming distance. Bit sampling compares the walks
at SAMPLES random steps; REPEATS independent walks bring recall to its target. Steps are sampled below one and a half
times the item's length, so that windows have the size of the items of a size class. The items' walks are also
started at their later words, as far as the allowed edits reach, so a copy whose first words were changed has a
window that starts with a true match.

Two exact bounds come first: a window within the allowed edits starts with one of the item's first words and holds
enough words of the benchmark's vocabulary. What the walks bring together is verified by the exact edit distance of the
item to the closest part of the text around the window; a document is contaminated if that is at most
(1 - SIMILARITY) of the item's words.

Spark deals the items by hash into blocks of about BLOCK_WORDS words, whatever their number and lengths, and writes each
into the shared folder; only the number of blocks reaches the driver. Documents pass through one map and are never
shuffled: its worker holds about HELD_BYTES of documents, walks over the blocks' files with them and keeps the last block
for the next documents, so one block at a time is in memory however large the benchmark is.

Edge cases: null and empty texts and items match nothing; repeated items are found under each of their ids, a null
item_id included; repeated documents have repeated results; an empty benchmark leaves every document clean; long texts
are searched whole, SEARCH_BYTES or one text at a time; columns of the documents are carried through untouched: with_matches refuses a
name that the documents have, clean_documents takes one that they have not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm import files
from lithos.llm.shared import n_words, shared_dir, table
from lithos.llm.wordhash import blocks, closest_within, word_codes

SIMILARITY = 0.8
REPEATS = 12
SAMPLES = 3
#: The first sampled step lies in the first of so many parts of a walk.
EARLY = 10
#: Words of the items that a worker holds at once.
BLOCK_WORDS = 400_000
#: Bytes of text that go over all blocks together, and that are searched at once.
HELD_BYTES = 32 << 20
SEARCH_BYTES = 1 << 20


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_codes(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))


class Benchmark:
    """A block of items, ready to be searched for."""

    def __init__(self, ids: list, texts: list, similarity: float = SIMILARITY, repeats: int = REPEATS, samples: int = SAMPLES, seed: int = 9):
        hashes, codes, offsets = _words(pa.array(texts, pa.string()))
        self.vocab = np.sort(hashes)
        symbols = np.searchsorted(self.vocab, hashes) + 1  # 0: a word outside the benchmark
        self.ids, self.items, self.edits, self.masks = [], [], [], []
        for k, item in enumerate(ids):
            words = symbols[codes[offsets[k] : offsets[k + 1]]]
            if len(words):
                self.ids.append(item)
                self.items.append(words)
                self.edits.append(int((1 - similarity) * len(words) + 1e-9))
                masks: dict = {}
                for i, w in enumerate(words.tolist()):
                    masks[w] = masks.get(w, 0) | 1 << i
                self.masks.append(masks)
        rng = np.random.default_rng(seed)
        self.classes = []
        by: dict[int, list[int]] = {}
        for k, x in enumerate(self.items):
            by.setdefault(int(np.log(len(x)) / np.log(1.3)), []).append(k)
        for members in by.values():
            self.classes.append(self._class(members, repeats, samples, rng))

    def _class(self, members: list[int], repeats: int, samples: int, rng) -> dict:
        sizes = [len(self.items[k]) for k in members]
        steps = max(samples + 1, int(1.5 * min(sizes)))
        first = np.zeros(len(self.vocab) + 1, bool)
        starts = [(k, f) for k in members for f in range(self.edits[k] + 1)]
        for k, f in starts:
            first[self.items[k][f]] = True
        upto = np.cumsum([0, *sizes])
        place = dict(zip(members, upto.tolist(), strict=False))
        flat = np.concatenate([*(self.items[k] for k in members), [0]])
        begin = np.array([place[k] + f for k, f in starts])
        end = np.array([place[k] + len(self.items[k]) for k, _ in starts])
        walks = []
        for _ in range(repeats):
            bits = rng.integers(0, 2, (steps, len(self.vocab) + 1), dtype=np.uint8)
            early = max(2, steps // EARLY)  # a sample soon after the start ends most walks there
            rest = rng.choice(np.arange(early, steps), min(samples - 1, steps - early), replace=False) if samples > 1 and steps > early else np.zeros(0, np.int64)
            at = np.sort(np.concatenate(([rng.integers(1, early)], rest)))
            key, i, sets = flat[begin], begin.copy(), []
            for t in range(int(at[-1]) + 1):
                now = np.where(i < end, flat[np.minimum(i, end)], 0)
                if t in at:
                    key = np.where((now == 0) | (key < 0), -1, _chain(key, now))
                    sets.append(np.unique(key[key >= 0]))
                i = i + bits[t][now]
            order = np.argsort(key, kind="stable")
            order = order[key[order] >= 0]
            walks.append((bits, at, sets, key[order], order))
        return {"need": min(len(self.items[k]) - self.edits[k] for k in members), "span": max(len(self.items[k]) + self.edits[k] for k in members), "first": first, "starts": starts, "walks": walks}

    def search(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text, (item, distance, first word of the window) of every item found; items by their place in ids."""
        found: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(texts))]
        hashes, codes, offsets = _words(texts)
        if not len(codes) or not self.items:
            return [[] for _ in found]
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        symbol = np.where(self.vocab[at] == hashes, at + 1, 0)[codes]
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        upto = np.concatenate(([0], np.cumsum(symbol > 0)))
        padded = np.concatenate((symbol, [0]))
        for c in self.classes:
            p = np.flatnonzero(c["first"][symbol])
            end = offsets[1:][doc[p]]
            p = p[upto[np.minimum(p + c["span"], end)] - upto[p] >= c["need"]]
            end = offsets[1:][doc[p]]
            tried: set[tuple[int, int]] = set()
            for bits, sampled, sets, keys, order in c["walks"]:
                live, stop, i, key, level = p, end, np.zeros(len(p), np.int64), symbol[p], 0
                for t in range(int(sampled[-1]) + 1):
                    if not len(live):
                        break
                    now = padded[np.where(live + i < stop, live + i, len(symbol))]
                    if t == sampled[level]:
                        key = _chain(key, now)
                        where = np.minimum(np.searchsorted(sets[level], key), len(sets[level]) - 1) if len(sets[level]) else None
                        ok = (now > 0) & (sets[level][where] == key) if where is not None else np.zeros(len(live), bool)
                        live, stop, i, key, now, level = live[ok], stop[ok], i[ok], key[ok], now[ok], level + 1
                        if level == len(sampled):
                            break
                    i = i + bits[t][now]
                if level == len(sampled) and len(live):
                    lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    for x, a, b in zip(live.tolist(), lo.tolist(), hi.tolist(), strict=True):
                        for k in order[a:b].tolist():
                            self._verify(c["starts"][k], x, doc, offsets, symbol, tried, found)
        return [[(k, d, s) for k, (d, s) in sorted(x.items())] for x in found]

    def _verify(self, start, x: int, doc, offsets, symbol, tried, found) -> None:
        k, f = start
        n, most, j = len(self.items[k]), self.edits[k], int(doc[x])
        if k in found[j] or (k, x - f) in tried:
            return
        tried.add((k, x - f))
        lo, hi = max(int(offsets[j]), x - f - most), min(int(offsets[j + 1]), x - f + n + most)
        d, _ = closest_within(self.masks[k], n, symbol[lo:hi].tolist())
        if d <= most:
            found[j][k] = (d, x - f - int(offsets[j]))


def _chain(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A key of 62 bits from a key and the next sampled word."""
    x = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) & np.uint64((1 << 62) - 1)).astype(np.int64)


def _blocks(items: DataFrame, block_words: int) -> list[str]:
    """The folders of the blocks into which Spark writes the items."""
    spark = items.sparkSession
    rows = items.select("item_id", "text").where(n_words(F.col("text")) > 0)
    total = rows.agg(F.sum(n_words(F.col("text")))).first()[0] or 0
    if not total:
        return []
    folder = shared_dir(spark, "benchmark")
    rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-int(total) // block_words)))).repartition(F.col("block")).write.partitionBy("block").parquet(folder)
    return sorted(f"{folder}/block={r[0]}" for r in spark.read.parquet(folder).select("block").distinct().collect())


def _read_block(folder: str) -> tuple[list, list]:
    where, path = files.at(folder)
    parts = sorted(x.path for x in where.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet"))
    ids, texts = [], []
    for part in parts:
        with where.open_input_file(part) as f:
            t = pq.read_table(f, columns=["item_id", "text"])
        ids += t.column("item_id").to_pylist()
        texts += t.column("text").to_pylist()
    return ids, texts


def with_matches(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS, similarity: float = SIMILARITY, matches: str = "matches") -> DataFrame:
    """docs and a column matches: array of (item_id, distance, start), start being the window's first word."""
    if matches in docs.columns:
        raise ValueError(f"the documents have a column {matches!r}; name another one for the matches")
    kind = "array<struct<item_id:bigint,distance:int,start:bigint>>"
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64())]))
    out = docs.withColumn(matches, F.array().cast(kind))
    schema = out.schema

    folders = _blocks(items, block_words)
    if not folders:
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, last, bench = list(range(len(folders))), None, None
        for batch in _held(batches, HELD_BYTES):
            found: list[list[list]] = [[[] for _ in folders] for _ in range(batch.num_rows)]
            for b in walk:
                if b != last:
                    bench = None  # the next block is built after the last one is gone
                    bench, last = Benchmark(*_read_block(folders[b]), similarity=similarity), b
                at = 0
                for rows in blocks(iter([batch]), SEARCH_BYTES):
                    for i, hits in enumerate(bench.search(rows.column("text"))):
                        found[at + i][b] = [{"item_id": bench.ids[k], "distance": d, "start": s} for k, d, s in hits]
                    at += rows.num_rows
            walk.reverse()  # the block at hand comes first for the next documents
            own = pa.array([[m for hits in x for m in hits] for x in found], arrow)
            at = batch.schema.get_field_index(matches)
            yield pa.RecordBatch.from_arrays([own if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return out.mapInArrow(task, schema)


def _held(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold size bytes of text."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column("text").nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    name = "matches"
    while name in docs.columns:
        name += "_"
    return with_matches(docs, items, matches=name).where(F.size(name) == 0).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.sort_array(F.transform("matches", lambda x: x["item_id"])).alias("item_ids"), F.array_min(F.transform("matches", lambda x: x["distance"])).alias("least_distance"))
