"""Words of whole texts as 64-bit hashes, and sets of word shingles.

A word is a run of characters other than space and U+0009 to U+000D. Those
characters are single bytes in UTF-8 and ``bytes.split()`` cuts exactly at
them; ``bytes.lower()`` changes A-Z only.
"""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                        0xA0761D6478BD642F], dtype=np.uint64)


def to_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a text as UTF-8; a null text has none."""
    if not text:
        return []
    raw = to_bytes(text)
    return (raw.lower() if lower else raw).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for every window of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for j in range(width):
        total += hashes[j:j + n] * MULTIPLIERS[j % len(MULTIPLIERS)]
    return mix(total)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of the lower-cased text.

    With fewer words than ``width`` the whole sequence is the one shingle;
    without words the set is empty.
    """
    hashes = hash_words(split_words(text, lower=True))
    if len(hashes) == 0:
        return hashes
    return np.unique(windows(hashes, min(width, len(hashes))))
