"""Word shingles as 64-bit numbers."""

from __future__ import annotations

import hashlib

import numpy as np

from plumbline.llm.shared import pieces

_AROUND = b".,;:!?\"'`()[]{}<>*_-"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """A word's 64-bit number; remembers short words, up to a bounded number."""

    def __init__(self, most: int = 1 << 19):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        number = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = number
        return number

    def of(self, text: bytes) -> np.ndarray:
        """The numbers of a text's words: runs of bytes between ASCII blanks, A-Z in lower case."""
        parts = [np.fromiter(map(self.__getitem__, p), np.uint64, len(p)) for p in pieces(text.lower())]
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)


class PlainWords(Words):
    """Words without the punctuation around them; punctuation alone is no word (number 0)."""

    def __missing__(self, word: bytes) -> int:
        plain = word.strip(_AROUND)
        number = int.from_bytes(hashlib.blake2b(plain, digest_size=8).digest(), "little") or 1 if plain else 0
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = number
        return number

    def of(self, text: bytes) -> np.ndarray:
        parts = [np.fromiter(map(self.__getitem__, p), np.uint64, len(p)) for p in pieces(text.lower())]
        words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        return words[words > 0]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of `size` words; fewer words are one run, none have none."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    value = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        value = mixed(value * _SPREAD + words[k : n - size + 1 + k])
    return value
