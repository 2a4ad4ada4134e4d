"""Peaks of one-dimensional profiles: smoothing, height, distance and prominence. Profiles are short (bins of a height)."""

from __future__ import annotations

import numpy as np


def smoothed(values: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Gaussian smoothing; beyond its ends the profile is mirrored, its end values repeated."""
    values = np.asarray(values, float)
    reach = int(truncate * sigma + 0.5)
    if not len(values) or not reach:
        return values
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    at = np.arange(-reach, len(values) + reach) % (2 * len(values))
    mirrored = values[np.where(at < len(values), at, 2 * len(values) - 1 - at)]
    return np.convolve(mirrored, weight / weight.sum(), "valid")


def maxima(values: np.ndarray) -> np.ndarray:
    """Places higher than both sides; of a plateau the middle, the left one of two. The ends are none."""
    values = np.asarray(values)
    if len(values) < 3:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    last = np.concatenate((first[1:], [len(values)])) - 1
    inside = (first > 0) & (last < len(values) - 1)
    first, last = first[inside], last[inside]
    top = (values[first - 1] < values[first]) & (values[last + 1] < values[last])
    return (first[top] + last[top]) // 2


def prominence(values: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """How far a peak stands above the higher of the lowest points on its two ways to higher ground or an end."""
    out = np.empty(len(peaks))
    for k, p in enumerate(peaks):
        higher = np.flatnonzero(values > values[p])
        left, right = higher[higher < p], higher[higher > p]
        lo, hi = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else len(values))
        out[k] = values[p] - max(values[lo : p + 1].min(), values[p:hi].min())
    return out


def peaks(values: np.ndarray, height: float | None = None, distance: int = 1, least_prominence: float | None = None) -> np.ndarray:
    """Maxima that reach a height; then, from the highest on, those that no kept one is nearer to than distance (of equal
    ones the later first); then those of enough prominence."""
    values = np.asarray(values, float)
    found = maxima(values)
    if height is not None:
        found = found[values[found] >= height]
    keep = np.ones(len(found), bool)
    for k in np.lexsort((np.arange(len(found)), values[found]))[::-1]:
        if keep[k]:
            keep &= (np.abs(found - found[k]) >= distance) | (np.arange(len(found)) == k)
    found = found[keep]
    return found if least_prominence is None else found[prominence(values, found) >= least_prominence]
