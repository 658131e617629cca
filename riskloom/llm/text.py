"""Words, 64-bit digests and shingle sets, shared by the operators of this package.

These are small helpers of Python tasks; Spark partitions and shuffles the work.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5

_ODD = np.array(
    [int.from_bytes(hashlib.blake2b(b"place %d" % i, digest_size=8).digest(), "little") | 1 for i in range(64)],
    np.uint64,
)


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased (other letters stay)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def digests(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def scrambled(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word, so that order statistics are uniform."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Digest of every run of ``width`` digests, in order."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += values[i : i + n] * _ODD[i]
    return scrambled(total)


def shingle_set(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Sorted digests of the distinct shingles; a shorter text is one shingle as a whole."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(digests(words), min(width, len(words))))


def text_digest(words: list[bytes]) -> bytes | None:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def combined(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of a signature; the band's number is part of its key."""
    rows = signature.reshape(bands, -1)
    return scrambled((rows * _ODD[: rows.shape[1]]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
