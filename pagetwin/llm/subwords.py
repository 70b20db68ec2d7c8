"""Hashed character n-grams of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from operator import eq

import numpy as np

#: Code points handled in one go; windows overlap so that no n-gram is lost.
WINDOW = 1 << 18


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@cache
def shapes() -> np.ndarray:
    """Code point to its shape: a, A, 0, white space as it is, marks as they are, anything else as a letter without case."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        out[c] = 97 if s.islower() else 65 if s.isupper() else 48 if s.isdigit() else 98 if s.isalpha() else c
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hash(parts: list[np.ndarray], salt: int, buckets: int) -> np.ndarray:
    acc = np.full(len(parts[0]), salt * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for p in parts:
        acc = (acc ^ p) * np.uint32(0x85EBCA6B)
        acc ^= acc >> np.uint32(15)
    return acc & np.uint32(buckets - 1)


def word_grams(text: str, buckets: int, sizes=(2, 3, 4)) -> Iterator[np.ndarray]:
    """Buckets of letter n-grams inside words, both ends marked, window by window. Nothing else of the text counts."""
    cp = code_points(text.lower())
    c = np.where(letters()[cp], cp, 0) if len(cp) else cp
    c = np.concatenate([[0], c, [0]]).astype(np.uint32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep]
    for lo in range(0, len(c), WINDOW):
        w = c[lo : lo + WINDOW + max(sizes) - 1]
        for n in sizes:
            m = min(len(w) - n + 1, WINDOW)
            if m <= 0:
                continue
            ok = np.ones(m, bool)
            for k in range(1, n - 1):
                ok &= w[k : m + k] != 0
            yield _hash([w[k : m + k][ok] for k in range(n)], n, buckets)


def raw_grams(text: str, buckets: int, sizes=(1, 2, 3), shape_sizes=(2, 3, 4, 5)) -> Iterator[np.ndarray]:
    """Buckets of n-grams of the code points, of their shapes, and of what words and lines repeat, window by window."""
    yield from repeat_grams(text, buckets)
    cp = code_points(text)
    for c, ns, salt in ((cp, sizes, 0), (shapes()[cp] if len(cp) else cp, shape_sizes, 64)):
        for lo in range(0, len(c), WINDOW):
            w = c[lo : lo + WINDOW + max(ns) - 1]
            for n in ns:
                m = min(len(w) - n + 1, WINDOW)
                if m > 0:
                    yield _hash([w[k : m + k] for k in range(n)], salt + n, buckets)


def repeat_grams(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of patterns of repetition: whether words equal the one, and the second, before them, and lines the one before."""
    words, lines = text.split(), text.split("\n")
    for salt, seq, gap in ((128, words, 1), (136, words, 2), (144, lines, 1)):
        same = np.fromiter(map(eq, seq[gap:], seq), bool, max(0, len(seq) - gap)).astype(np.uint32) + np.uint32(1)
        for n in (1, 3):
            m = len(same) - n + 1
            if m > 0:
                yield _hash([same[k : m + k] for k in range(n)], salt + n, buckets)


def counts(grams: Iterator[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that occur, their counts)."""
    total, held, size = np.zeros(buckets, np.int64), [], 0
    for g in grams:
        held.append(g)
        size += len(g)
        if size > 8 * WINDOW:
            total += np.bincount(np.concatenate(held), minlength=buckets)
            held, size = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=buckets)
    at = np.flatnonzero(total)
    return at, total[at]
