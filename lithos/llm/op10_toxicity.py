"""Operator 10: toxicity by a convolutional text classifier, trained in numpy.

Words (lower-cased, punctuation off) are embedded by the sum of rows of a hashed table: two for the word, so that words
which share one row with an insult do not share its meaning, and one for each of its beginnings, so that an inflected or
compound form of a known stem is known too. Filters of several widths run over the whole text, their largest values are
pooled, and a logistic layer gives the score. Training goes over all labelled rows that are not held out: in each round the
tasks go on from one model over rows of their own, and every parameter becomes the mean over the tasks that moved it. The
model has one size at any input (TABLE x DIM numbers); scoring is one map over all texts with the model broadcast. A fifth
of the rows is kept from training to calibrate: the score's 0.5 is the threshold with the best F1 there, by counts of all of
them, and every language with enough such rows gets a threshold of its own.

Labels, language, source and doc_id are no inputs of the score; the language only picks the threshold of toxic_by_lang.

Edge cases: null and empty texts get the score of a text without words; a text shorter than a filter is padded; null
languages take the common threshold; rows with a null or repeated doc_id are scored like all others, and a null doc_id
counts as not held out; without any labelled rows, or with labels of one kind, every score is that label's share (0.0
without labels); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm.shared import stored, table
from lithos.llm.wordhash import blocks, mix, word_codes

TABLE = 1 << 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Passes over all labelled rows, more of them (up to MOST_ROUNDS) where all rows are few, and the unit of rows whose root
#: gives the number of learners.
ROUNDS, MOST_ROUNDS, FEW_ROWS = 4, 12, 60_000
LEARNER_ROWS = 6_000
#: Table rows of a learner's change that are one row, and steps of a logit by which calibration counts.
CHUNK_ROWS = 1_024
STEPS = 256
BATCH = 32
RATE = 0.08
CALIBRATION = 5
LANG_ROWS = 30
HELD_OUT = 5
#: Lengths of the beginnings of a word that have rows of their own.
PREFIXES = (3, 4, 5, 6, 7)
PAD = max(WIDTHS) - 1
#: Bytes of the texts that a task scores together; a longer text is scored alone.
BLOCK_BYTES = 2_000_000
EDGES = "\"'.,;:!?()[]{}<>#*$%&|~`-_/\\"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table rows of every distinct word, index of each word, offsets); row TABLE stands for none."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    kept: list[pa.Array] = []

    def clean(words: pa.Array) -> pa.Array:
        kept.append(pc.utf8_trim(words, EDGES))
        return kept[0]

    hashes, codes, offsets = word_codes(lower, clean)
    if not len(hashes):
        return np.zeros((0, 2 + len(PREFIXES)), np.int64), codes, offsets
    rows = [mix(hashes ^ np.uint64(s)) % np.uint64(TABLE) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    length = pc.utf8_length(kept[0]).to_numpy(zero_copy_only=False)
    for n in PREFIXES:
        some = np.flatnonzero(length > n)
        row = np.full(len(hashes), TABLE, np.uint64)
        if len(some):
            starts = pc.utf8_slice_codeunits(kept[0].take(pa.array(some)), 0, n).dictionary_encode()
            h = pd.util.hash_array(starts.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
            row[some] = (mix(h ^ np.uint64(n * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)) % np.uint64(TABLE))[starts.indices.to_numpy(zero_copy_only=False)]
        rows.append(row)
    return np.stack(rows, 1).astype(np.int64), codes, offsets


def _padded(codes: np.ndarray, offsets: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes with PAD blanks after each text, and the texts' offsets."""
    n = np.diff(offsets) + PAD
    upto = np.concatenate(([0], np.cumsum(n)))
    out = np.full(upto[-1], blank, np.int64)
    out[np.arange(len(codes)) + np.repeat(np.arange(len(n)) * PAD, np.diff(offsets))] = codes
    return out, upto


class Classifier:
    def __init__(self, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.table = np.concatenate((rng.normal(0, 0.1, (TABLE, DIM)), np.zeros((1, DIM)))).astype(np.float32)
        self.filters = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.seen = {k: np.full_like(v, 1e-3) for k, v in self._named().items()}
        self.shift, self.by_lang, self.constant = 0.0, {}, None

    def _responses(self, embedded: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Filter values at every place; embedded has the distinct words' vectors and a last row of zeros."""
        parts = []
        for f in self.filters:
            each = [(embedded @ f[j])[index] for j in range(len(f))]
            y = each[0].copy()
            for j in range(1, len(f)):
                y[:-j] += each[j][j:]
            parts.append(y)
        return np.concatenate(parts, 1) + self.bias

    def _embedded(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate((self.table[rows].sum(1), np.zeros((1, DIM), np.float32)))

    def logits(self, texts: pa.Array) -> np.ndarray:
        rows, codes, offsets = _words(texts)
        index, upto = _padded(codes, offsets, len(rows))
        y = np.maximum(self._responses(self._embedded(rows), index), 0)
        y[index == len(rows)] = 0
        return (np.maximum.reduceat(y, upto[:-1], axis=0) @ self.out + self.base).astype(np.float64)

    def learn(self, texts: pa.Array, labels: np.ndarray, weights: dict[int, float], rng: np.random.Generator) -> None:
        """One pass of stochastic gradients with per-parameter rates; only the places of the largest values pass gradients on.
        weights are those of the labels."""
        rows, codes, offsets = _words(texts)
        seen, weight = self.seen, np.where(labels == 1, weights[1], weights[0])

        def step(name: str, grad: np.ndarray, at=slice(None)) -> None:
            seen[name][at] += grad * grad
            self._named()[name][at] -= RATE * grad / np.sqrt(seen[name][at])

        order = rng.permutation(len(texts))
        for pick in np.split(order, range(BATCH, len(order), BATCH)):
            local = np.concatenate([codes[offsets[i] : offsets[i + 1]] for i in pick])
            use, at = np.unique(local, return_inverse=True)
            sizes = np.concatenate(([0], np.cumsum([offsets[i + 1] - offsets[i] for i in pick])))
            index, upto = _padded(at, sizes, len(use))
            embedded = self._embedded(rows[use])
            y = self._responses(embedded, index)
            y[index == len(use)] = -1
            where = np.stack([upto[k] + y[upto[k] : upto[k + 1]].argmax(0) for k in range(len(pick))])
            pooled = np.maximum(y[where, np.arange(y.shape[1])], 0)
            p = 1 / (1 + np.exp(-(pooled @ self.out + self.base)))
            error = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            back = error[:, None] * self.out * (pooled > 0)
            moved = np.zeros_like(embedded)
            step("out", pooled.T @ error)
            step("base", error.sum(keepdims=True))
            step("bias", back.sum(0))
            for i, f in enumerate(self.filters):
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                grad = np.zeros_like(f)
                for j in range(len(f)):
                    word = index[np.minimum(where[:, cols] + j, len(index) - 1)]
                    grad[j] = np.einsum("bfd,bf->df", embedded[word], back[:, cols])
                    np.add.at(moved, word, back[:, cols, None] * f[j].T[None])
                step(f"filter{i}", grad)
            touched = np.flatnonzero(np.abs(moved[:-1]).sum(1))
            at_rows, inverse = np.unique(rows[use[touched]], return_inverse=True)
            grad = np.zeros((len(at_rows), DIM), np.float32)
            np.add.at(grad, inverse.reshape(-1), np.repeat(moved[touched], rows.shape[1], 0))
            real = at_rows < TABLE
            step("table", grad[real], at_rows[real])

    def _named(self) -> dict[str, np.ndarray]:
        return {"table": self.table, "bias": self.bias, "out": self.out, "base": self.base} | {f"filter{i}": f for i, f in enumerate(self.filters)}

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-(self.logits(texts) - self.shift)))


def best_threshold(logits: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> float:
    """The middle of the gap between distinct logits at which F1 is best; toxic and rows are counts at each logit."""
    order = np.argsort(-logits, kind="stable")
    z, hit = logits[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.cumsum(rows[order]) + toxic.sum())
    k = int(f1.argmax())
    return float((z[k] + (z[k + 1] if k + 1 < len(z) else z[k] - 1)) / 2)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, lang, toxic of all labelled rows that are not held out, and whether they are kept for calibration.

    The join is a merge at any size: labels grow with the documents, so a small input's broadcast of them would not last.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    text = F.coalesce("text", F.lit(""))
    return docs.join(usable.hint("merge"), "doc_id").select(text.alias("text"), "lang", "toxic", (F.pmod(F.xxhash64(text), F.lit(CALIBRATION)) == 0).alias("kept"))


def learners(rows: int, learner_rows: int = LEARNER_ROWS) -> int:
    """The number of learners of so many rows. Each hands on changes of the model's size, so they grow as the root of the rows:
    what a round shuffles grows slower than the input, and so does the longest task."""
    return math.ceil(math.sqrt(rows / learner_rows))


def train(docs: DataFrame, labels: DataFrame, learner_rows: int = LEARNER_ROWS) -> Classifier:
    """A classifier from all labelled rows that are not held out; whole groups of equal texts are kept for calibration."""
    rows = stored(labelled(docs, labels), "toxicity")
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("kept", "toxic").count().collect()}  # four rows
    model = Classifier()
    of = lambda kept, toxic: counts.get((kept, toxic), 0)
    n = {k: of(True, k) + of(False, k) for k in (0, 1)}
    if not n[0] or not n[1]:
        model.constant = 1.0 if n[1] else 0.0
        return model
    apart = all(of(kept, k) for kept in (True, False) for k in (0, 1))
    fit, kept = (rows.where("NOT kept"), rows.where("kept")) if apart else (rows, rows)
    each = {k: of(False, k) if apart else n[k] for k in (0, 1)}
    weights = {k: 0.5 * sum(each.values()) / each[k] for k in (0, 1)}
    for k in range(min(MOST_ROUNDS, max(ROUNDS, -(-FEW_ROWS // sum(each.values()))))):
        _round(model, fit.select("text", "toxic").coalesce(learners(sum(each.values()), learner_rows)), weights, k)
    _calibrate(model, kept)
    return model


def _round(model: Classifier, rows: DataFrame, weights: dict[int, float], number: int) -> None:
    """Every task goes on from the model over its rows; a parameter becomes the mean of the tasks that moved it."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, own = shipped.value, copy.deepcopy(shipped.value)
        rng = np.random.default_rng([number, TaskContext.get().partitionId()])
        for batch in blocks(batches, BLOCK_BYTES):
            own.learn(batch.column("text"), batch.column("toxic").to_numpy(), weights, rng)
        for name, now in own._named().items():
            moved, seen = now - old._named()[name], own.seen[name] - old.seen[name]
            for k in range(0, len(now), CHUNK_ROWS):
                if seen[k : k + CHUNK_ROWS].any():
                    yield pa.RecordBatch.from_pydict({"name": [name], "at": [k], "moved": [moved[k : k + CHUNK_ROWS].tobytes()], "seen": [seen[k : k + CHUNK_ROWS].tobytes()]})

    def mean(t: pa.Table) -> pa.Table:
        moved, seen = (np.stack([np.frombuffer(x, np.float32) for x in t.column(c).to_pylist()]).astype(np.float64) for c in ("moved", "seen"))
        by = np.maximum((seen > 0).sum(0), 1)
        return pa.table({"name": t.column("name")[:1], "at": t.column("at")[:1]} | {c: pa.array([(v.sum(0) / by).astype(np.float32).tobytes()], pa.binary()) for c, v in (("moved", moved), ("seen", seen))})

    schema = "name string, at long, moved binary, seen binary"
    for r in rows.mapInArrow(task, schema).groupBy("name", "at").applyInArrow(mean, schema).toLocalIterator():  # the model's size
        for whole, change in ((model._named()[r["name"]], r["moved"]), (model.seen[r["name"]], r["seen"])):
            part = whole[r["at"] : r["at"] + CHUNK_ROWS]
            part += np.frombuffer(change, np.float32).reshape(part.shape)
    shipped.destroy()


def _calibrate(model: Classifier, rows: DataFrame) -> None:
    """Thresholds of all texts and of each language, from counts of all rows by steps of their logits."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES):
            step = np.rint(shipped.value.logits(batch.column("text")).clip(-40, 40) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column("lang"), batch.column("toxic")], names=["step", "lang", "toxic"])

    by = rows.select("text", "lang", "toxic").mapInArrow(task, "step long, lang string, toxic int").groupBy("lang", "step").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    got = by.toPandas()  # at most a row for each language and step of a logit
    whole = got.groupby("step")[["toxic", "n"]].sum()
    limit = lambda g: best_threshold(g.index.to_numpy() / STEPS, g["toxic"].to_numpy(), g["n"].to_numpy())
    model.shift = limit(whole)
    for k, g in got.dropna(subset=["lang"]).groupby("lang"):
        if min(g["toxic"].sum(), (g["n"] - g["toxic"]).sum()) * 2 >= LANG_ROWS:
            model.by_lang[k] = float(1 / (1 + np.exp(-(limit(g.groupby("step")[["toxic", "n"]].sum()) - model.shift))))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score, predicted and toxic_by_lang of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES):
            s = shipped.value.scores(batch.column("text"))
            limit = np.array([shipped.value.by_lang.get(k, 0.5) for k in batch.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(s >= limit)], names=["doc_id", "held_out", "score", "predicted", "toxic_by_lang"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "lang", "text")
    return rows.mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int, toxic_by_lang boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
