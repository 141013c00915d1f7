"""Hashed byte n-grams: the subwords of the language and toxicity models."""

from __future__ import annotations

import numpy as np

#: Lengths of n-grams.
ORDERS = (3, 4, 5)


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    table[0x41:0x5B] += 32
    for c in (0x09, 0x0A, 0x0B, 0x0C, 0x0D):
        table[c] = 0x20
    return table


_LOWER = _lower_table()


def buckets(raw: bytes, bits: int) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram at every byte; the text is fenced by blanks, A-Z lower-cased."""
    data = _LOWER[np.frombuffer(b" " + raw + b" ", np.uint8)]
    out, h = [], data
    for n in range(2, ORDERS[-1] + 1):
        if len(data) < n:
            h = np.zeros(0, np.uint32)
        else:
            h = h[:-1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            out.append(_bucket(h, bits))
    return out


def by_order(raw: bytes, bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each order, the n-grams within a word and its fences: their buckets, the blanks before the word's end, their places in the text, and the order."""
    data = _LOWER[np.frombuffer(b" " + raw + b" ", np.uint8)]
    blanks = np.concatenate(([0], np.cumsum(data == 0x20)))
    parts = []
    h = data
    for n in range(2, ORDERS[-1] + 1):
        if len(data) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            last = len(data) - n + 1
            place = np.flatnonzero(blanks[n - 1 : n - 1 + last] == blanks[1 : 1 + last])  # no blank but at the ends
            parts.append((_bucket(h[place], bits), blanks[1 + place], place, n))
    return parts


def word_grams(raw: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each n-gram within a word and its fences, by word: its bucket, the word's number, its place in the text and its length."""
    parts = by_order(raw, bits)
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    grams, word, place, size = (np.concatenate(x) for x in zip(*((g, w, p, np.full(len(p), n)) for g, w, p, n in parts), strict=True))
    order = np.argsort(word, kind="stable")
    word = np.unique(word[order], return_inverse=True)[1]
    return grams[order].astype(np.int64), word, place[order], size[order]


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
