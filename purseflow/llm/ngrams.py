"""Hashes of words and of letter n-grams, for many texts at once with numpy.

The texts are joined to one array of bytes. Prefix sums of byte values times powers
of an odd base, modulo 2^64, give the hash of any stretch of bytes by one
subtraction and one product with a power of the base's inverse.
"""

from __future__ import annotations

import re

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: White space and punctuation outside ASCII; it parts words as ASCII punctuation does.
_OUTSIDE = re.compile("[\u0080-©«-´¶-¹»-¿×÷  -⁯₠-⃏←-⯿　-〃〈-】﻿]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = _mix(np.arange(1, 257, dtype=np.uint64))
_WORD_BYTE = np.array([chr(b).isalnum() or b >= 0x80 for b in range(128)] + [True] * 128)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def normal(text: str | None) -> bytes:
    """Lower case, with white space for punctuation outside ASCII."""
    text = (text or "").lower()
    if not text.isascii():
        text = _OUTSIDE.sub(" ", text)
    return text.encode("utf-8", "surrogatepass")


class Words:
    """The words of a batch of texts: runs of ASCII letters and digits and of bytes outside ASCII.

    ``start`` and ``end`` are places in ``data``; ``hash`` is each word's hash; the
    words of text i are those from ``first[i]`` up to ``first[i + 1]``.
    """

    def __init__(self, texts: list[bytes]):
        joined = b" ".join([b"", *texts, b""])
        self.data = data = np.frombuffer(joined, np.uint8)
        inside = _WORD_BYTE[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data] * powers(BASE, n), dtype=np.uint64, out=self.prefix[1:])
        self.inverse = powers(_INVERSE, n)
        self.hash = _mix((self.prefix[self.end] - self.prefix[self.start]) * self.inverse[self.start])
        begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.begins = begins
        self.first = np.searchsorted(self.start, begins)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of each run of n bytes that ends inside a word or just after one
        and starts inside it or just before; white space and punctuation count alike."""
        clear = np.where(_WORD_BYTE[self.data], _VALUE[self.data], np.uint64(1))
        prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(clear * powers(BASE, len(self.data)), dtype=np.uint64, out=prefix[1:])
        at = np.arange(len(self.data) - n + 1) if len(self.data) >= n else np.zeros(0, np.int64)
        gap = np.r_[0, np.cumsum(~_WORD_BYTE[self.data])]
        inner = gap[at + n - 1] - gap[at + 1]  # of the places between the first and the last
        at = at[inner == 0]
        return _mix((prefix[at + n] - prefix[at]) * self.inverse[at] + np.uint64(n)), at


def batches(texts: list[str | None], limit: int = 1 << 20):
    """Index and normal form of the texts, in groups of about ``limit`` bytes; a longer
    text is cut between words, and its parts come with the same index."""
    held, index, size = [], [], 0
    for i, t in enumerate(texts):
        whole = normal(t)
        at = 0
        while True:
            cut = len(whole)
            if cut - at > limit:
                cut = whole.find(b" ", at + limit)
                cut = len(whole) if cut < 0 else cut
            held.append(whole[at:cut])
            index.append(i)
            size += cut - at + 1
            if size > limit:
                yield np.array(index), held
                held, index, size = [], [], 0
            at = cut
            if at >= len(whole):
                break
    if held:
        yield np.array(index), held
