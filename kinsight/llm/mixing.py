"""Repeatable 64-bit hashes and uniform numbers, the same on every executor."""

from __future__ import annotations

import numpy as np


def mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor) of each value."""
    with np.errstate(over="ignore"):
        x = np.asarray(values).astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # in place, for most calls are on many values
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def uniform(hashes: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from 64-bit hashes."""
    out = (hashes >> np.uint64(11)).astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return out
