"""Hashed n-gram features over UTF-8 bytes, in numpy, with memory bounded for any text length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
SPACE = 32


def ngrams(data: bytes, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Arrays of bucket numbers below 2**bits: the n-grams of space-separated words, word edges included.

    An n-gram may begin or end with the space that bounds its word but has none inside.
    """
    whole = np.frombuffer(b" " + data + b" ", np.uint8)
    for start in range(0, len(whole), PIECE):
        part = whole[start : start + PIECE + max(sizes) - 1]
        wide = part.astype(np.uint32)
        blank = part == SPACE
        for n in sizes:
            count = min(PIECE, len(part) - n + 1)
            if count <= 0:
                continue
            value = np.full(count, n, np.uint32)
            inside = np.zeros(count, bool)
            for j in range(n):
                value = value * np.uint32(0x01000193) + wide[j : j + count] + np.uint32(1)
                if 0 < j < n - 1 or n == 1:
                    inside |= blank[j : j + count]
            value ^= value >> np.uint32(15)
            value *= np.uint32(0x85EBCA6B)
            yield (value >> np.uint32(32 - bits))[~inside].astype(np.int64)


def word_hashes(data: bytes, bits: int) -> Iterator[np.ndarray]:
    """Arrays of bucket numbers of whole space-separated words; a word over 1 MB counts in pieces."""
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, len(whole), PIECE):
        part = whole[start : start + PIECE]
        blank = np.concatenate([[True], part == SPACE, [True]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        if not len(edges):
            continue
        first = edges[::2]
        place = np.arange(len(part), dtype=np.uint64)
        began = np.repeat(np.append(0, first), np.diff(np.concatenate([[0], first, [len(part)]]))).astype(np.uint64)
        within = place - began
        mixed = (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= (within * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
        mixed[part == SPACE] = 0
        total = np.add.reduceat(mixed, first)
        total ^= total >> np.uint64(31)
        total *= np.uint64(0x94D049BB133111EB)
        yield (total >> np.uint64(64 - bits)).astype(np.int64)


def summed(weights: np.ndarray, arrays: Iterator[np.ndarray]) -> tuple[np.ndarray, int]:
    """Sum of the weight rows of all features, and their number."""
    total, n = np.zeros(weights.shape[1], np.float64), 0
    for h in arrays:
        if len(h) < len(weights) // 4:
            total += weights[h].sum(0, dtype=np.float64)
        else:
            total += np.bincount(h, minlength=len(weights)) @ weights
        n += len(h)
    return total, n


def sparse(arrays: Iterator[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their shares of all features."""
    counts = np.zeros(buckets, np.int64)
    for h in arrays:
        counts += np.bincount(h, minlength=buckets)
    at = np.flatnonzero(counts)
    return at, (counts[at] / max(1, counts.sum())).astype(np.float32)
