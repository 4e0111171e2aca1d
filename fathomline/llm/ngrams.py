"""Texts as arrays of character classes, and their n-grams as numbers."""

from __future__ import annotations

import numpy as np

#: Classes are 6 bits: 0 for what is no letter, 1 to 26 for a to z, the rest for other letters by their code point.
BITS = 6
_PLAIN = 0x250


def _classes() -> np.ndarray:
    table = np.zeros(_PLAIN, np.uint8)
    for c in range(_PLAIN):
        low = chr(c).lower()[0]
        if not chr(c).isalpha():
            continue
        table[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 37
    return table


CLASSES = _classes()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def classes(text: str) -> np.ndarray:
    """The class of each character; those from U+0250 on are letters (of scripts without a table here) unless str.isalpha denies it."""
    points = code_points(text)
    out = CLASSES[np.minimum(points, _PLAIN - 1)]
    if len(points) and points.max() >= _PLAIN:
        for k in np.flatnonzero(points >= _PLAIN):
            c = text[k]
            out[k] = 27 + int(points[k]) % 37 if c.isalpha() else 0
    return out


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """The n-grams of classes as numbers of n * BITS bits."""
    if len(c) < n:
        return np.zeros(0, np.int64)
    out = c[: len(c) - n + 1].astype(np.int64 if n * BITS > 31 else np.int32)
    for k in range(1, n):
        out <<= BITS
        out |= c[k : len(c) - n + 1 + k]
    return out.astype(np.int64, copy=False)
