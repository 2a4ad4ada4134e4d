"""Operator 13: alignment of two tokenizers by an associative monoid of fragments.

Both tokenizers cut the same bytes, so their tokens are two rows of intervals. Offsets where a token of each ends are the
cuts between groups. A chunk of a text's bytes holds the tokens that end in it and gives a fragment: an open prefix (tokens
up to its first cut), closed groups, and an open suffix (tokens after its last cut); a fragment without a cut is all open.
Two neighbouring fragments compose by closing what the left suffix and the right prefix make together, which is
associative, with the empty fragment as identity. A text of at most CHUNK_BYTES is one fragment; the chunks of a longer one
are rows of their own and are reduced by a tree, FAN neighbours at a time, so composing is spread over tasks.

Neither tokenizer joins a character other than white space with a space after it (the piece vocabulary is checked for that,
the byte-level pattern has it by its form), so a text is cut at such spaces and each distinct unit of a bucket of texts is
encoded once. In a short text the units are closed fragments that only need to be put together; a long one is cut at
arbitrary bytes.

Counts by documents: a bucket of about BUCKET_BYTES of text sends each of its distinct pairs once, with the number of its
documents that have it. The sums go back to the buckets that asked, where the documents' pairs look them up. No row is
shuffled per link, and a pair that every document has is one row per bucket.

Edge cases: null and empty texts and texts whose tokens do not give back their bytes (such as those with U+2581) have
zeros and an empty groups_sha256, and count for no pair; rows with null or repeated doc_ids are documents of their own; a
unit of any length is encoded as one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm.shared import stored, table

CHUNK_BYTES = 32_768
BUCKET_BYTES = 6_000_000
FAN = 8
#: Units that are encoded together: a tokenizer's own rows of tokens are far larger than the ids that are kept.
UNITS_AT_ONCE = 8_192
#: A space between two characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
PAIR = 1 << 32


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Coded:
    """Tokens of units: ids of all, and where each unit's begin and end; good: whether they give back the unit's bytes."""

    a: np.ndarray
    a_at: np.ndarray
    b: np.ndarray
    b_at: np.ndarray
    good: np.ndarray


def gathered(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows which of ragged values, one after the other, and where they begin and end."""
    size = np.diff(at)[which]
    upto = np.concatenate(([0], np.cumsum(size)))
    return values[np.arange(upto[-1]) + np.repeat(at[which] - upto[:-1], size)], upto


class Tokenizers:
    """Two vocabularies with the bytes of each token."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        alphabet, own = byte_alphabet(), self.a.get_vocab()
        names = {i: t for t, i in own.items()}
        self.a_bytes = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in (names.get(i, "") for i in range(max(names) + 1))]
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", x) for x in names):
            raise ValueError("the piece vocabulary joins words: texts cannot be cut at spaces")
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.a_len, self.b_len = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        #: each id with a comma, a bar and a semicolon after it
        self.pool = pa.array([f"{i}{c}".encode() for i in range(most) for c in ",|;"], pa.large_binary())

    def encode(self, units: list[str], at_once: int = UNITS_AT_ONCE) -> Coded:
        """The tokens of each unit with a space before it; so many units at once, of which only the ids are kept."""
        parts = [self._encode(units[lo : lo + at_once]) for lo in range(0, max(1, len(units)), at_once)]
        bounds = lambda at: np.concatenate(([0], np.cumsum(np.concatenate([np.diff(x) for x in at]))))
        flat = [np.concatenate([getattr(x, k) for x in parts]) for k in ("a", "b", "good")]
        return Coded(flat[0], bounds([x.a_at for x in parts]), flat[1], bounds([x.b_at for x in parts]), flat[2])

    def _encode(self, units: list[str]) -> Coded:
        spaced = [" " + x for x in units]
        a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1) if units else []
        at = [np.concatenate(([0], np.cumsum(np.fromiter(map(len, x), np.int64, len(x))))) for x in (a, b)]
        flat = [np.fromiter(chain.from_iterable(x), np.int64, int(y[-1])) for x, y in zip((a, b), at, strict=True)]
        good = np.ones(len(units), bool)
        want = "".join(spaced).encode()
        for ids, y, sizes, names in ((flat[0], at[0], self.a_len, self.a_bytes), (flat[1], at[1], self.b_len, self.b_bytes)):
            upto = np.concatenate(([0], np.cumsum(sizes[ids])))[y]
            each = np.fromiter((len(x.encode()) for x in spaced), np.int64, len(spaced))
            if (np.diff(upto) != each).any() or b"".join(map(names.__getitem__, ids.tolist())) != want:
                for k, x in enumerate(spaced):
                    good[k] &= b"".join(map(names.__getitem__, ids[y[k] : y[k + 1]].tolist())) == x.encode()
        return Coded(flat[0], at[0], flat[1], at[1], good)


_loaded: dict[tuple, Tokenizers] = {}


def tokenizers(paths: tuple[str, str]) -> Tokenizers:
    if paths not in _loaded:
        _loaded[paths] = Tokenizers(*paths)
    return _loaded[paths]


@dataclass
class Groups:
    """Closed groups: cuts (their ends), ends (of the links' stretches), the pairs of these, and the groups' texts.

    texts holds one row per group, which ends in a semicolon.
    """

    cuts: np.ndarray
    ends: np.ndarray
    pairs: np.ndarray
    texts: pa.LargeBinaryArray


def grouped(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, both: Tokenizers) -> Groups:
    """The groups of tokens that begin and end at cuts. A link is a stretch between two neighbouring ends."""
    cuts, ends = np.intersect1d(a_end, b_end, assume_unique=True), np.union1d(a_end, b_end)
    pairs = a[np.searchsorted(a_end, ends)] * PAIR + b[np.searchsorted(b_end, ends)]
    ga, gb = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    named = np.concatenate((3 * a + (cuts[ga] == a_end), 3 * b + 2 * (cuts[gb] == b_end)))
    order = np.argsort(np.concatenate((2 * ga, 2 * gb + 1)), kind="stable")
    texts = both.pool.take(pa.array(named[order]))
    each = np.bincount(ga, minlength=len(cuts)) + np.bincount(gb, minlength=len(cuts))
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)[np.concatenate(([0], np.cumsum(each)))] if len(texts) else np.zeros(1, np.int64)
    return Groups(cuts, ends, pairs, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(at.tobytes()), texts.buffers()[2]]))


@dataclass
class Fragment:
    """Open tokens are arrays of id and end (in bytes of the text). prefix and suffix: (tokens of A, tokens of B).

    cut tells whether there is a cut; without one all tokens are in prefix. text has the closed groups, each with a
    semicolon after it; pairs are the distinct pairs of the closed groups, A id * 2**32 + B id, and links their numbers.
    """

    prefix: tuple[np.ndarray, np.ndarray]
    cut: bool
    n_groups: int
    text: bytes
    pairs: np.ndarray
    links: np.ndarray
    suffix: tuple[np.ndarray, np.ndarray]


def _no_tokens() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)


def open_fragment(tokens: tuple[np.ndarray, np.ndarray] | None = None, cut: bool = False) -> Fragment:
    """A fragment of open tokens, which with cut end at its only cut; without tokens and cut it is the identity."""
    none = np.zeros(0, np.int64)
    return Fragment(tokens or _no_tokens(), cut, 0, b"", none, none, _no_tokens())


def closed_groups(a: np.ndarray, b: np.ndarray, both: Tokenizers) -> tuple[int, bytes, np.ndarray, np.ndarray]:
    """(groups, their text, distinct pairs, links) of tokens between two cuts."""
    g = grouped(a[:, 0], a[:, 1], b[:, 0], b[:, 1], both)
    pairs, links = np.unique(g.pairs, return_counts=True)
    return len(g.cuts), b"".join(g.texts.to_pylist()), pairs, links


def fragment(a: np.ndarray, b: np.ndarray, both: Tokenizers) -> Fragment:
    """The fragment of the tokens (id, end) that end in a chunk."""
    cuts = np.intersect1d(a[:, 1], b[:, 1], assume_unique=True)
    if not len(cuts):
        return open_fragment((a, b))
    (a1, a2), (b1, b2) = (np.searchsorted(x[:, 1], cuts[[0, -1]], "right") for x in (a, b))
    return Fragment((a[:a1], b[:b1]), True, *closed_groups(a[a1:a2], b[b1:b2], both), (a[a2:], b[b2:]))


def compose(x: Fragment, y: Fragment, both: Tokenizers) -> Fragment:
    """x followed by y."""
    if not x.cut:
        return replace(y, prefix=tuple(np.concatenate(t) for t in zip(x.prefix, y.prefix, strict=True)))
    if not y.cut:
        return replace(x, suffix=tuple(np.concatenate(t) for t in zip(x.suffix, y.prefix, strict=True)))
    n, text, pairs, links = closed_groups(*(np.concatenate(t) for t in zip(x.suffix, y.prefix, strict=True)), both)
    every, which = np.unique(np.concatenate((x.pairs, pairs, y.pairs)), return_inverse=True)
    total = np.bincount(which, np.concatenate((x.links, links, y.links)), len(every)).astype(np.int64)
    return Fragment(x.prefix, True, x.n_groups + n + y.n_groups, x.text + text + y.text, every, total, y.suffix)


def closed(x: Fragment, both: Tokenizers) -> Fragment:
    """The fragment of a whole text, closed at its start and its end."""
    whole = compose(open_fragment(cut=True), x, both)
    if any(map(len, whole.suffix)):
        raise ValueError("a text must end at a cut")
    return whole


def to_bytes(x: Fragment) -> dict:
    """A fragment as columns."""
    flat = lambda t: t.astype("<i8").tobytes()
    return {
        "cut": x.cut,
        "prefix_a": flat(x.prefix[0]),
        "prefix_b": flat(x.prefix[1]),
        "groups": x.text,
        "n_groups": x.n_groups,
        "pairs": flat(x.pairs),
        "links": flat(x.links),
        "suffix_a": flat(x.suffix[0]),
        "suffix_b": flat(x.suffix[1]),
    }


def from_bytes(r: dict) -> Fragment:
    flat = lambda c: np.frombuffer(r[c], "<i8")
    tokens = lambda c: flat(c).reshape(-1, 2)
    return Fragment((tokens("prefix_a"), tokens("prefix_b")), r["cut"], r["n_groups"], r["groups"], flat("pairs"), flat("links"), (tokens("suffix_a"), tokens("suffix_b")))


def units_of(text: str) -> list[str]:
    """The text cut at its safe spaces, which are dropped: each unit is encoded with a space before it."""
    return CUT.split(text)


def distinct_units(units: list[str]) -> tuple[list[str], np.ndarray]:
    coded = pa.array(units, pa.string()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def chunks(text: str, both: Tokenizers, chunk_bytes: int) -> list[tuple[int, int, Fragment]] | None:
    """(number of A tokens, of B tokens, fragment) for each range of chunk_bytes of a long text; None for a mismatch."""
    units, which = distinct_units(units_of(text))
    known = both.encode(units)
    if not known.good.all():
        return None
    tokens = []
    for ids, at, sizes in ((known.a, known.a_at, both.a_len), (known.b, known.b_at, both.b_len)):
        mine = gathered(ids, at, which)[0]
        tokens.append(np.stack((mine, np.cumsum(sizes[mine])), 1))
    out = []
    for lo in range(0, int(tokens[0][-1, 1]), chunk_bytes):
        inside = [t[slice(*np.searchsorted(t[:, 1], [lo, lo + chunk_bytes], "right"))] for t in tokens]  # that end in (lo, lo + chunk_bytes]
        out.append((len(inside[0]), len(inside[1]), fragment(*inside, both)))
    return out


FRAGMENT = "cut boolean, prefix_a binary, prefix_b binary, groups binary, n_groups long, pairs binary, links binary, suffix_a binary, suffix_b binary"
ROW = f"kind string, bucket string, doc_id long, text_no long, chunk long, n_a long, n_b long, n_links long, groups_sha256 string, {FRAGMENT}, pair long, n_docs long"
FRAGMENT_COLUMNS = [c.split()[0] for c in FRAGMENT.split(", ")]
COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(c, kinds[t]) for c, t in (x.split() for x in ROW.split(", "))])


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{c: r.get(c) for c in COLUMNS} for r in rows], schema=arrow_schema())


def pair_rows(bucket: str, pairs: np.ndarray, n_docs: np.ndarray) -> pa.RecordBatch:
    """One row per distinct pair of a bucket, with the number of its documents that have it."""
    columns = {"kind": ["pair"] * len(pairs), "bucket": [bucket] * len(pairs), "pair": pairs.astype(np.int64), "n_docs": n_docs.astype(np.int64)}
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(pairs), f.type) for f in arrow_schema()]
    return pa.RecordBatch.from_arrays(arrays, schema=arrow_schema())


def document(doc_id: int | None, text_no: int, bucket: str, n_a: int, n_b: int, x: Fragment | None) -> dict:
    """A document's row; pairs are numbers of the sorted distinct pairs of its bucket, which is its own."""
    row = {"kind": "doc", "bucket": bucket, "doc_id": doc_id, "text_no": text_no}
    if x is None:
        return row | {"n_a": 0, "n_b": 0, "n_links": 0, "n_groups": 0, "groups_sha256": "", "pairs": b"", "links": b""}
    return row | {
        "n_a": n_a,
        "n_b": n_b,
        "n_links": int(x.links.sum()),
        "n_groups": x.n_groups,
        "groups_sha256": hashlib.sha256(x.text[:-1]).hexdigest(),
        "pairs": np.arange(len(x.pairs)).astype("<u4").tobytes(),
        "links": x.links.astype("<u4").tobytes(),
    }


def short_rows(bucket: str, numbers: list[int], ids: list, cut: list[list[str]], both: Tokenizers) -> Iterator[pa.RecordBatch]:
    """Document rows and pair rows of texts in units, all at once."""
    units, which = distinct_units([u for c in cut for u in c])
    at = np.concatenate(([0], np.cumsum([len(c) for c in cut])))
    known = both.encode(units)
    good = np.flatnonzero(known.good)
    (a, a_at), (b, b_at) = gathered(known.a, known.a_at, good), gathered(known.b, known.b_at, good)
    a_end, b_end = np.cumsum(both.a_len[a]), np.cumsum(both.b_len[b])
    g = grouped(a, a_end, b, b_end, both)
    unit_end = np.concatenate(([0], a_end))[a_at]
    group_at, link_at = np.searchsorted(g.cuts, unit_end, "right"), np.searchsorted(g.ends, unit_end, "right")
    text_at = np.frombuffer(g.texts.buffers()[1], np.int64, len(g.cuts) + 1)[group_at]
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(good), [None, pa.py_buffer(text_at.tobytes()), g.texts.buffers()[2]])
    place = np.full(len(units), -1)
    place[good] = np.arange(len(good))
    bad = np.add.reduceat((~known.good)[which], at[:-1]) > 0  # every text has a unit
    mine = place[which[np.repeat(~bad, np.diff(at))]]
    doc_at = np.concatenate(([0], np.cumsum(np.where(bad, 0, np.diff(at)))))
    total = lambda bounds: np.diff(np.concatenate(([0], np.cumsum(np.diff(bounds)[mine])))[doc_at])
    kinds, number = np.unique(g.pairs, return_inverse=True)
    pairs, pair_at = gathered(number.astype(np.int64), link_at, mine)
    n_links = total(link_at)
    keys, links = np.unique(np.repeat(np.arange(len(cut)), n_links) << 32 | pairs, return_counts=True)
    docs, pairs = keys >> 32, keys & 0xFFFFFFFF
    cuts = np.searchsorted(docs, np.arange(len(cut) + 1)).astype(np.int64) * 4
    whole = texts.take(pa.array(mine))
    bounds = np.frombuffer(whole.buffers()[1], np.int64, len(mine) + 1)[doc_at] if len(mine) else np.zeros(len(doc_at), np.int64)
    data = memoryview(whole.buffers()[2]) if len(mine) else memoryview(b"")
    shas = ["" if x == y else hashlib.sha256(data[x : y - 1]).hexdigest() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    packed = lambda x: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(x.astype("<u4").tobytes())]).cast(pa.binary())
    columns = {
        "kind": ["doc"] * len(cut),
        "bucket": [bucket] * len(cut),
        "doc_id": ids,
        "text_no": numbers,
        "n_a": total(a_at),
        "n_b": total(b_at),
        "n_links": n_links,
        "n_groups": total(group_at),
        "groups_sha256": shas,
        "pairs": packed(pairs),
        "links": packed(links),
    }
    arrays = [pa.nulls(len(cut), f.type) if f.name not in columns else x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in arrow_schema()]
    yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema())
    yield pair_rows(bucket, kinds, np.bincount(pairs, minlength=len(kinds)))


def bucket_rows(bucket: str, first_no: int, ids: list, texts: list[str], both: Tokenizers, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Documents, their distinct pairs, and the chunks of the long ones."""
    size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
    short = [k for k, n in enumerate(size) if 0 < n < chunk_bytes]
    if short:
        yield from short_rows(bucket, [first_no + k for k in short], [ids[k] for k in short], [units_of(texts[k]) for k in short], both)
    for k, n in enumerate(size):
        if n < chunk_bytes:
            if not n:
                yield batch_of([document(ids[k], first_no + k, bucket, 0, 0, None)])
            continue
        parts = chunks(texts[k], both, chunk_bytes)
        if parts is None:
            yield batch_of([document(ids[k], first_no + k, bucket, 0, 0, None)])
        else:
            yield batch_of([{"kind": "chunk", "bucket": bucket, "doc_id": ids[k], "text_no": first_no + k, "chunk": c, "n_a": a, "n_b": b} | to_bytes(f) for c, (a, b, f) in enumerate(parts)])


def encoded(docs: DataFrame, paths: tuple[str, str], bucket_bytes: int = BUCKET_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of three kinds: doc, chunk (of a long text) and pair (of a bucket), stored."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part, made, done = tokenizers(paths), TaskContext.get().partitionId(), 0, 0
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                held += len(texts[-1]) + 64
                if held >= bucket_bytes:
                    yield from bucket_rows(f"{part}-{made}", done, ids, texts, both, chunk_bytes)
                    pa.default_memory_pool().release_unused()
                    made, done = made + 1, done + len(ids)
                    ids, texts, held = [], [], 0
        if ids:
            yield from bucket_rows(f"{part}-{made}", done, ids, texts, both, chunk_bytes)

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, ROW), "alignment")


def composed(rows: DataFrame, paths: tuple[str, str], fan: int = FAN) -> DataFrame:
    """doc and pair rows of the texts that came in chunks; a text is a bucket of its own."""

    def step(t: pa.Table) -> pa.Table:
        parts = sorted(t.to_pylist(), key=lambda r: r["chunk"])
        whole, both = open_fragment(), tokenizers(paths)
        for r in parts:
            whole = compose(whole, from_bytes(r), both)
        row = parts[0] | to_bytes(whole) | {"chunk": parts[0]["chunk"] // fan} | {c: sum(r[c] for r in parts) for c in ("n_a", "n_b")}
        return pa.Table.from_batches([batch_of([row])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(paths)
        for r in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            x, bucket = closed(from_bytes(r), both), f"{r['bucket']}-{r['text_no']}"
            yield batch_of([document(r["doc_id"], r["text_no"], bucket, r["n_a"], r["n_b"], x)])
            yield pair_rows(bucket, x.pairs, np.ones(len(x.pairs)))

    open_ = rows.where("kind = 'chunk'")
    left = open_.agg(F.max("chunk")).first()[0]
    if left is None:
        return open_
    while left:
        # a whole run of neighbours has one key, at most fan rows
        open_ = stored(open_.groupBy("bucket", "text_no", F.expr(f"chunk div {fan}").alias("run")).applyInArrow(step, ROW), "alignment-chunks")
        left //= fan
    return stored(open_.mapInArrow(finish, ROW), "alignment-long")


def aligned(docs: DataFrame, paths: tuple[str, str], bucket_bytes: int = BUCKET_BYTES, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""

    def lookup(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """The documents of a bucket, with the counts that the bucket asked for."""
        order = np.argsort(answers.column("pair").to_numpy())
        n, best = answers.column("n").to_numpy()[order], answers.column("best").to_numpy(zero_copy_only=False)[order]
        n_best, total = [], []
        for p, w in zip(docs.column("pairs").to_pylist(), docs.column("links").to_pylist(), strict=True):
            at, w = np.frombuffer(p, "<u4"), np.frombuffer(w, "<u4").astype(np.int64)
            n_best.append(int(w[best[at].astype(bool)].sum()))
            total.append(int((w * n[at]).sum()))
        out = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        return pa.table(out | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())})

    rows = encoded(docs, paths, bucket_bytes, chunk_bytes)
    rows = rows.where("kind <> 'chunk'").unionByName(composed(rows, paths, fan).where("kind <> 'chunk'"))
    asked = rows.where("kind = 'pair'").select("bucket", "pair", "n_docs")
    counts = asked.groupBy("pair").agg(F.sum("n_docs").alias("n"))
    first = counts.groupBy(F.expr(f"pair div {PAIR}").alias("a")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("a", F.expr(f"pair div {PAIR}")).join(first, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asked.select(F.col("bucket").alias("asker"), "pair").join(counts, "pair")
    found = rows.where("kind = 'doc'").select("bucket", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return found.groupBy("bucket").cogroup(answers.groupBy("asker")).applyInArrow(lookup, out)


def vocabularies() -> tuple[str, str]:
    """Files of public tokenizers: byte-level (A) and pieces (B)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), vocabularies())
