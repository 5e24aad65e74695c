"""Words and word shingles of whole texts, hashed in numpy blocks.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z only, which is what `bytes.lower().split()` gives on UTF-8.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

SHINGLE = 5
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SHORT = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash per window of `size` words; position i covers words i .. i+size-1."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = word_hashes[:n].copy()
    for k in range(1, size):
        out *= _MULT
        out += word_hashes[k : k + n]
    return mix(out)


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words has its whole sequence as one."""
    words = [words_of(t) for t in texts]
    hashes = hash_words([w for ws in words for w in ws])
    windows = shingle_hashes(hashes, size)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= size:
            out.append(np.unique(windows[at : at + n - size + 1]))
        elif n:
            whole = np.array([n], np.uint64) * _SHORT
            for h in hashes[at : at + n]:
                whole = whole * _MULT + h
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def blocks(ids: list, texts: list, limit: int = 1 << 19):
    """Runs of (ids, texts) of about `limit` bytes of text, so that memory follows the longest text at most."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield ids[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(ids):
        yield ids[start:], texts[start:]


#: Lower-cases A-Z and blanks the rest of ASCII that is neither letter nor digit; other bytes stay.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Words without case and ASCII punctuation, for matching beyond exact spelling."""
    return text.translate(_LETTERS).split() if text else []


class HashIndex:
    """Places of many 64-bit hashes among a few sorted ones; a bit table turns most of them away first."""

    def __init__(self, keys: np.ndarray, bits: int = 18):
        self.keys, self.shift = np.unique(keys), np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in hashes, places in keys) of the hashes that are keys."""
        at = np.flatnonzero(self.table[(hashes >> self.shift).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[place] == hashes[at]
        return at[hit], place[hit]
