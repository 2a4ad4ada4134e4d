"""Hashes of the words of a batch of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most size bytes of text, or one row."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64) + 1)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + size, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def word_codes(texts: pa.Array, clean=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes of the distinct words, index of every word among them, offsets of the texts).

    Words are cut at ASCII white space; a null text has none. clean, if given, is applied to the distinct words.
    """
    pieces = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    coded = pieces.flatten().dictionary_encode()
    words = (clean(coded.dictionary) if clean else coded.dictionary).to_numpy(zero_copy_only=False).astype(object)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    which = coded.indices.to_numpy(zero_copy_only=False)
    full = (words != "")[which]
    upto = np.concatenate(([0], np.cumsum(full)))
    return pd.util.hash_array(words, categorize=False), which[full], upto[ends]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, offsets of the texts)."""
    hashes, which, offsets = word_codes(texts)
    return hashes[which], offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def banded_distance(a, b, most: int) -> int:
    """Edit distance of two sequences of hashables, or most + 1 if it is larger.

    Only the diagonals within most of the main one are computed: a column of the band is a pair of bit vectors, so a
    step costs a few operations on integers of 2 * most + 1 bits.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    n = len(a)
    lo = 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[n - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    a, b = a[lo : n - hi], b[lo : len(b) - hi]
    m, n = len(a), len(b)
    if not m or not most:
        return n if n <= most else most + 1
    most_here = min(most, n)
    where: dict = {}
    for i, x in enumerate(b):  # rows of the matrix
        where[x] = where.get(x, 0) | 1 << i
    # bit r of the vectors at column j is row j - most_here + r + 1; rows above the first read as a falling column
    width = 2 * most_here + 1
    full = (1 << width) - 1
    vp, vn = (full << most_here) & full, 0
    score = most_here  # of the lowest diagonal's cell at column 0
    top = 1 << (width - 1)
    row = most_here  # the row of the highest bit at column 0
    for j in range(1, m + 1):
        shift = j - most_here - 1  # row index (from 0) of bit 0 at column j
        x = where.get(a[j - 1], 0)
        x = (x >> shift if shift >= 0 else x << -shift) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if row < n:  # the highest bit goes down its diagonal until the last row
            row += 1
            score += 0 if d0 & top else 1
        else:  # then the last row is followed to the right, a bit lower at each column
            at = 1 << (width - 1 - (j - (n - most_here)))
            score += 1 if hp & at else 0
            score -= 1 if hn & at else 0
        d0 >>= 1
        vp, vn = (hn | ~(d0 | hp)) & full, d0 & hp
    return score if score <= most else most + 1


def closest_within(masks: dict, m: int, text) -> tuple[int, int]:
    """(distance, end) of the part of text that is closest to a pattern of m words, given as bit masks by word."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, at = score, j + 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
    return best, at
