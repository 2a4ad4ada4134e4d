"""Operator 3: token ids in binary shards, compressed by a Re-Pair grammar per shard.

Texts are range-partitioned and sorted by doc_id; each task encodes its texts and closes a shard after SHARD_TOKENS ids,
so a task holds one shard at a time. Within a shard the frequent adjacent pairs of symbols are replaced by nonterminals,
round by round, until no pair is frequent. The file stores the rules, the length of each rule's expansion, and where each
document starts, so a document or a slice of one is decoded without touching the rest. Pairs never cross a document's end.

The word-level vocabulary drops white space and its pre-tokens never span it, so texts are cut at ASCII white space and
each distinct word is encoded once per worker (a cache of bounded size), with the same ids as the whole text would give. Words
are cut from the punctuation after them and put in lower case by the batch, in Arrow.

Edge cases: null and empty texts hold the end id alone; null doc_ids come first; repeated doc_ids stand next to one
another; a text longer than a shard makes a larger shard of its own; extra columns are ignored; an empty table writes no
shard and returns no rows.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithos.llm import files
from lithos.llm.shared import shared_dir, stored, table

END_ID = 1
SHARD_TOKENS = 4_000_000
#: A pair is frequent if it occurs so often in its shard; rounds and pairs per round bound the work on a shard.
MIN_COUNT = 24
MAX_ROUNDS = 16
PAIRS_A_ROUND = 2048
CACHE_WORDS = 400_000
ROWS = 2_000
#: Words that are encoded together, and what stands between them: a character that no word of text has.
WORDS_AT_ONCE = 20_000
MARK = "\x01"
#: Punctuation that is encoded apart from the word before it, if that ends in a letter below U+0100; not what ends a special token.
TAIL = ".,;:!?#*$%&|<"
LETTERS, LOWER = "A-Za-zÀ-ÖØ-öø-ÿ", "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
WITH_TAIL, ONLY_LETTERS = f"[{LETTERS}ªµº][{TAIL}]+$", f"^[{LETTERS}]+$"
MAGIC = b"RPSHARD1"


def word_ids(words: list[str], tokenizer) -> list[bytes]:
    """The ids of each word. Words are encoded as one text with a mark between them, which costs less than a text each: white
    space keeps them apart, and the mark's id tells where one ends. Where that cannot tell, each is a text of its own."""
    mark = tokenizer.encode(MARK, add_special_tokens=False).ids
    if len(mark) == 1 and not any(MARK in x for x in words):
        whole = tokenizer.encode_batch_fast([f" {MARK} ".join([*words, ""])], add_special_tokens=False)[0].ids
        ids = np.fromiter(whole, np.uint32, len(whole))
        ends = np.flatnonzero(ids == mark[0])
        if len(ends) == len(words):
            data, ends = ids.tobytes(), (4 * ends).tolist()
            return [data[a:b] for a, b in zip([0, *[e + 4 for e in ends[:-1]]], ends, strict=True)] if words else []
    return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def stems_and_tails(words: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray, list[str]]:
    """Words without the punctuation at their end, which of them had such, and that: a letter and a mark after it are never in
    one pre-token. With lower, stems of letters below U+0100 are in lower case, for a tokenizer that encodes them so."""
    tailed = pc.match_substring_regex(words, WITH_TAIL)
    stems = pc.if_else(tailed, pc.ascii_rtrim(words, TAIL), words)
    whole, cut = words.filter(tailed).to_numpy(zero_copy_only=False), stems.filter(tailed).to_numpy(zero_copy_only=False)
    if lower:
        stems = pc.if_else(pc.match_substring_regex(stems, ONLY_LETTERS), pc.utf8_lower(stems), stems)
    return stems, np.flatnonzero(tailed.to_numpy(zero_copy_only=False)), [w[len(c) :] for w, c in zip(whole, cut, strict=True)]


def letter_table(tokenizer) -> dict[int, str] | None:
    """What the pre-tokenizer makes of each lower-case letter, for str.translate; a word of such letters is then one word of the
    tokenizer's model. None if some letter, or all in a row, come out otherwise than by the whole tokenizer."""
    if not (getattr(tokenizer, "model", None) and getattr(tokenizer, "pre_tokenizer", None)):
        return None
    table = {ord(c): "".join(x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in LOWER}
    upper = "".join(c.upper() for c in LOWER if c not in "ßÿ")
    for word in [*LOWER, *upper, LOWER, LOWER[::-1], upper + LOWER]:
        if tokenizer.encode(word, add_special_tokens=False).ids != [t.id for t in tokenizer.model.tokenize(word.lower().translate(table))]:
            return None
    return table


class WordCache:
    """Ids by stem and by tail, in two generations: a full young one becomes the old one, from which those in use come back.
    Another tokenizer starts anew.

    Stems of letters alone go to the tokenizer's model at once, which costs a third of normalizing and cutting them again.
    """

    def __init__(self, size: int = CACHE_WORDS):
        self.size, self.young, self.old, self.tokenizer, self.table = size, {}, {}, None, None

    def __call__(self, words: list[str] | pa.Array, tokenizer) -> list[bytes]:
        if self.tokenizer is not tokenizer:
            self.tokenizer, self.table, self.young, self.old = tokenizer, letter_table(tokenizer), {}, {}
        stems, at, tails = stems_and_tails(pa.array(words, pa.large_string()), self.table is not None)
        coded = stems.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._fill([*names, *dict.fromkeys(tails)], tokenizer)
        per = list(map(self.young.__getitem__, names))
        out = list(map(per.__getitem__, coded.indices.to_numpy().tolist()))
        for i, tail in zip(at.tolist(), tails, strict=True):
            out[i] += self.young[tail]
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        return out

    def _fill(self, parts: list[str], tokenizer) -> None:
        """Bring the ids of all parts, which are distinct, into the young generation."""
        young, old, fresh = self.young, self.old, []
        for x in parts:
            if x not in young:
                if (known := old.get(x)) is None:
                    fresh.append(x)
                else:
                    young[x] = known
        if self.table and fresh:
            plain = pc.match_substring_regex(pa.array(fresh, pa.large_string()), ONLY_LETTERS).to_numpy(zero_copy_only=False)
            some, tokens = [x for x, y in zip(fresh, plain, strict=True) if y], tokenizer.model.tokenize
            fresh = [x for x, y in zip(fresh, plain, strict=True) if not y]
            for x, mapped in zip(some, "\n".join(some).translate(self.table).split("\n"), strict=False):
                young[x] = array("I", [t.id for t in tokens(mapped)]).tobytes()
        fresh = list(dict.fromkeys(fresh))
        for lo in range(0, len(fresh), WORDS_AT_ONCE):
            some = fresh[lo : lo + WORDS_AT_ONCE]
            young.update(zip(some, word_ids(some, tokenizer), strict=True))


_cache = WordCache()


@lru_cache(maxsize=1)
def tokenizer_of(tokenizer_json: str):
    """The tokenizer, loaded once per worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer_json)


def vocabulary(path: str | None = None) -> str:
    """The tokenizer's JSON; a file of a public tokenizer by default."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(texts: pa.Array, tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and the number of ids of each text."""
    pieces = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = pieces.offsets.to_numpy()
    coded = pieces.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    per = _cache(coded.dictionary, tokenizer)
    size = np.fromiter(map(len, per), np.int64, len(per)) // 4
    flat = np.frombuffer(b"".join(per), np.uint32)
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    which = coded.indices.to_numpy(zero_copy_only=False)
    each = size[which] if len(which) else np.zeros(0, np.int64)
    upto = np.concatenate(([0], np.cumsum(each)))
    ids = flat[np.arange(upto[-1]) + np.repeat(first[which] - upto[:-1], each)] if upto[-1] else np.zeros(0, np.uint32)
    return ids, np.diff(upto[ends - ends[0]])


def compress(symbols: np.ndarray, end: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """(symbols after replacement, rules as pairs); rule k is symbol end + 1 + k. Symbols fit 16 bits."""
    s, rules = symbols.astype(np.uint16), []  # a copy
    room = 65535 - end
    for _ in range(MAX_ROUNDS):
        left, right = s[:-1], s[1:]
        keys = np.sort((left.astype(np.uint32) << 16) | right)
        # of the sorted pairs, only those with an equal one min_count - 1 places on are counted; the others are not frequent
        often = keys[: max(0, len(keys) - min_count + 1)]
        often = often[often == keys[min_count - 1 :]]
        kind = often[np.concatenate(([True], often[1:] != often[:-1]))] if len(often) else often
        kind = kind[(kind >> 16 != end) & (kind & 65535 != end)]
        if not len(kind):
            break
        count = np.searchsorted(keys, kind, "right") - np.searchsorted(keys, kind)
        least = max(min_count, int(count.max()) // 4)
        chosen = np.flatnonzero(count >= least)
        chosen = chosen[np.argsort(-count[chosen], kind="stable")][: min(PAIRS_A_ROUND, room - len(rules))]
        if not len(chosen):
            break
        pairs = kind[chosen]
        a, b = (pairs >> 16).astype(np.int64), (pairs & 65535).astype(np.int64)
        in_left, in_right = np.zeros(65536, np.int32), np.zeros(65536, np.int32)
        ua, ub = np.unique(a), np.unique(b)
        in_left[ua], in_right[ub] = np.arange(1, len(ua) + 1) * (len(ub) + 1), np.arange(1, len(ub) + 1)
        rule = np.zeros((len(ua) + 1) * (len(ub) + 1), np.uint16)
        rule[in_left[a] + in_right[b]] = end + 1 + len(rules) + np.arange(len(pairs))
        row = in_left[left]
        p = np.flatnonzero(row != 0)
        found = rule[row[p] + in_right[right[p]]]
        some = found != 0
        p, found = p[some], found[some]
        head = np.concatenate(([True], np.diff(p) != 1))
        first = (np.arange(len(p)) - np.maximum.accumulate(np.where(head, np.arange(len(p)), 0))) % 2 == 0
        p = p[first]
        s[p] = found[first]
        keep = np.ones(len(s), bool)
        keep[p + 1] = False
        s = s[keep]
        rules += list(zip(a.tolist(), b.tolist(), strict=True))
        if len(rules) >= room:
            break
    return s, np.array(rules, np.uint16).reshape(-1, 2)


def expansion_lengths(rules: np.ndarray, end: int) -> np.ndarray:
    """For each rule, the number of ids that it stands for."""
    out = np.ones(end + 1 + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[end + 1 + k] = out[a] + out[b]
    return out[end + 1 :]


def pack(doc_ids: list, counts: np.ndarray, ids: np.ndarray, vocab: int) -> tuple[bytes, int]:
    """A shard's bytes from the ids of its documents (each with its end id), and the number of stored symbols."""
    if vocab >= 65535:
        raise ValueError(f"symbols have 16 bits: a vocabulary of {vocab} leaves no room for the mark and the rules")
    ends = np.cumsum(counts)
    symbols = ids.copy()
    symbols[ends - 1] = vocab  # the mark of a document's end, unlike the same id within a text
    seq, rules = compress(symbols, vocab)
    marks = np.flatnonzero(seq == vocab)
    parts = [
        np.array([x if x is not None else 0 for x in doc_ids], "<i8"),
        np.array([x is None for x in doc_ids], "u1"),
        counts.astype("<u4"),
        np.concatenate(([0], marks + 1)).astype("<u4"),
        rules.astype("<u2"),
        expansion_lengths(rules, vocab).astype("<u4"),
        seq.astype("<u2"),
    ]
    body = b"".join(x.tobytes() for x in parts)
    head = json.dumps({"docs": len(doc_ids), "rules": len(rules), "symbols": len(seq), "vocab": vocab, "end_id": END_ID, "crc32": zlib.crc32(body)}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + body, len(seq)


class Shard:
    """A shard read back; decode(k) gives a document's ids, decode(k, i, j) those from i to j."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard")
        (n,) = struct.unpack_from("<I", data, 8)
        head = json.loads(data[12 : 12 + n])
        body = memoryview(data)[12 + n :]
        if zlib.crc32(body) != head["crc32"]:
            raise ValueError("the shard is damaged")
        self.vocab, self.end_id, at = head["vocab"], head["end_id"], 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, count, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", head["docs"]), take("u1", head["docs"])
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.counts, self.starts = take("<u4", head["docs"]), take("<u4", head["docs"] + 1)
        rules, lengths = take("<u2", 2 * head["rules"]).reshape(-1, 2), take("<u4", head["rules"])
        self.seq = take("<u2", head["symbols"])
        base = self.vocab + 1
        self.length = np.concatenate((np.ones(base, np.int64), lengths.astype(np.int64)))
        # what every symbol stands for, one after the other; a rule's parts come before it
        self.first = np.concatenate(([0], np.cumsum(self.length)))
        flat = np.empty(self.first[-1], np.uint32)
        flat[:base] = np.arange(base)
        flat[self.vocab] = self.end_id
        for k, (a, b) in enumerate(rules.tolist()):
            i, la = self.first[base + k], self.length[a]
            flat[i : i + la] = flat[self.first[a] : self.first[a] + la]
            flat[i + la : i + self.length[base + k]] = flat[self.first[b] : self.first[b] + self.length[b]]
        self.flat = flat

    def expand(self, seq: np.ndarray) -> np.ndarray:
        each = self.length[seq]
        upto = np.cumsum(each)
        return self.flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.first[seq] - (upto - each), each)]

    def decode(self, k: int, i: int = 0, j: int | None = None) -> np.ndarray:
        seq = self.seq[self.starts[k] : self.starts[k + 1]]
        upto = np.cumsum(self.length[seq])
        j = int(upto[-1]) if j is None else min(j, int(upto[-1]))
        lo, hi = np.searchsorted(upto, i, "right"), np.searchsorted(upto, j, "left") + 1
        before = int(upto[lo - 1]) if lo else 0
        return self.expand(seq[lo:hi])[i - before : j - before]


def write_shards(docs: DataFrame, folder: str, tokenizer_json: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode docs(doc_id, text) into shard files; one row per shard: path, start, n_tokens, n_docs, n_symbols."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(tokenizer_json)  # one vocabulary file, whatever the size of the input

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = tokenizer_of(shipped.value)
        vocab, part = tokenizer.get_vocab_size(), TaskContext.get().partitionId()
        doc_ids, counts, ids, n, made = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, counts, ids, n, made
            data, symbols = pack(doc_ids, np.concatenate(counts), np.concatenate(ids), vocab)
            path = files.write_whole(folder, f"shard-{part:06d}-{made:06d}", data)
            row = pa.RecordBatch.from_pydict({"path": [path], "part": [part], "no": [made], "n_tokens": [n], "n_docs": [len(doc_ids)], "n_symbols": [symbols]})
            doc_ids, counts, ids, n, made = [], [], [], 0, made + 1
            return row

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                rows = batch.slice(lo, ROWS)
                got, each = encode(rows.column("text"), tokenizer)
                upto = np.cumsum(each)
                ids.append(np.insert(got, upto, END_ID).astype(np.uint32))
                counts.append(each + 1)
                doc_ids += rows.column("doc_id").to_pylist()
                n += len(ids[-1])
                if n >= shard_tokens:
                    yield close()
        if doc_ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    shards = stored(ordered.mapInArrow(task, "path string, part long, no long, n_tokens long, n_docs long, n_symbols long"), "repair-manifest")
    before = W.orderBy("part", "no").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    return shards.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), "n_tokens", "n_docs", "n_symbols")


def read_shards(shards: DataFrame) -> DataFrame:
    """Decode every document of the shards: doc_id, start, n_tokens, ids_crc32, n_symbols."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(files.read_whole(path))
                ids = shard.expand(shard.seq).astype("<u4")
                upto = np.concatenate(([0], np.cumsum(shard.counts.astype(np.int64))))
                if upto[-1] != len(ids):
                    raise ValueError(f"{path} holds {len(ids)} ids, {upto[-1]} were written")
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids, pa.int64()), "start": start + upto[:-1], "n_tokens": np.diff(upto), "ids_crc32": pa.array(crc, pa.int64()), "n_symbols": np.diff(shard.starts).astype(np.int64)})

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("path", "start").repartition(n, "path").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(table(spark, sf_dir, "documents"), shared_dir(spark, "repair"), vocabulary())
    return read_shards(shards)
