"""Hashed character n-grams, for the linear classifiers."""

from __future__ import annotations

import numpy as np


def codes(text: str) -> np.ndarray:
    """Code points of the text in lower case, white space as single spaces, with a space at either end."""
    folded = " " + " ".join(text.lower().split()) + " "
    return np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(text: str, orders: range, bits: int) -> np.ndarray:
    """A feature number below 2**bits for each character n-gram of the text, repeats included."""
    points = codes(text)
    value, out = points.copy(), []
    for order in range(1, orders.stop):
        if order > 1:
            value = value[:-1] * np.uint32(0x01000193) + points[order - 1 :] if len(value) > 1 else value[:0]
        if order in orders and len(value):
            out.append((value * np.uint32(0x9E3779B1) ^ np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits))
    return np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)


def present(features: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Each feature once. last: room for a number per feature, of any content."""
    at = np.arange(len(features), dtype=last.dtype)
    last[features] = at
    return features[last[features] == at]
