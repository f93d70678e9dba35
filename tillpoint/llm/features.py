"""Hashed text features shared by the two classifiers.

Features of a whole text: its words, word beginnings (4 and 5 characters) and the
shapes of neighbouring words (letter case, punctuation runs, repetition). Each is
hashed to one of ``2 ** bits`` weights. Presence features count once however long the
text is; shape features carry their share of the text's words.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np

BITS = 22
BUCKETS = 1 << BITS

_WORD = re.compile(r"[^\W_]+")


def terms(text: str) -> set[str]:
    """Distinct lower-case words and their beginnings (``abcd*``, ``abcde*``)."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:4] + "*" for w in words if len(w) >= 4} | {w[:5] + "*" for w in words if len(w) >= 5}


def _shape(token: str) -> str:
    """Letter case and punctuation of a token: ``Word,`` -> ``Aa,``; ``WORD!!`` -> ``A!!``."""
    head = token.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    tail = token[len(head):][:3]
    if not head:
        return tail
    kind = "0" if head.isdigit() else "A" if head.isupper() and len(head) > 1 else \
        "Aa" if head[:1].isupper() else "a" if head.islower() else "x"
    return kind + tail


def shapes(text: str) -> dict[str, float]:
    """Share of each token shape, and of tokens that repeat the one before."""
    tokens = text.split()
    counts: dict[str, float] = {}
    cache: dict[str, str] = {}
    last = None
    for token in tokens:
        shape = cache.get(token)
        if shape is None:
            shape = cache[token] = _shape(token)
        if token == last:
            shape = "=" + shape
        counts[shape] = counts.get(shape, 0) + 1
        last = token
    n = max(1, len(tokens))
    return {s: c / n for s, c in counts.items()}


def bucket(term: str) -> int:
    return crc32(term.encode()) & (BUCKETS - 1)


class Hasher:
    """Hashes terms, remembering those it has seen (up to ``limit``)."""

    def __init__(self, limit: int = 200_000):
        self.seen: dict[str, int] = {}
        self.limit = limit

    def __call__(self, found) -> np.ndarray:
        if len(self.seen) > self.limit:
            self.seen.clear()
        seen = self.seen
        for t in found:
            if t not in seen:
                seen[t] = bucket(t)
        return np.fromiter((seen[t] for t in found), np.int64, len(found))
