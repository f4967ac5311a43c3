"""Words of a text, and 64-bit hashes of word runs. Pure Python and NumPy, for use inside Arrow functions."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

#: The bracket escapes of tree banks.
BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LCB-": "{", "-RCB-": "}", "-LSB-": "[", "-RSB-": "]"}

_WORD = re.compile(r"[^\W_]+")
_ESCAPE = re.compile("|".join(BRACKETS))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
CACHE = 1 << 20


def words(text: str | None) -> list[str]:
    """NFC, bracket escapes read as brackets, lower case, maximal runs of letters and digits.
    Null, empty and blank texts have none."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "B-" in text:
        text = _ESCAPE.sub(lambda m: BRACKETS[m[0]], text)
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """64-bit hashes by word; emptied when full, so that memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def word_hashes(found: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words, in order of place; none if there are fewer words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = total * _STEP + hashes[k : k + m]
    return mix(total)


def sequence_hash(found: list[str]) -> tuple[int, int]:
    """128 bits of a word sequence, as two signed 64-bit integers."""
    h = xxhash.xxh3_128_intdigest("\x1f".join(found))
    a, b = h >> 64, h & (1 << 64) - 1
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)
