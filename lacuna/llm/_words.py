"""Words of texts as arrays of 64-bit hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

from ._spark import kept

#: Words whose hash a Python worker keeps at most; then the table starts anew.  Longer words than this many bytes
#: are hashed each time, so the table is bounded in bytes, too.
MEMO_WORDS, MEMO_BYTES = 200_000, 48
#: Bytes of a text that are split into words together.
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE_BYTES that end before white space: no word is cut."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        cut = _SPACE.search(text, at + PIECE_BYTES)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; kept between the tasks of an operator."""

    def __init__(self, digest=xxhash.xxh64_intdigest):
        super().__init__()
        self.digest = digest

    def __missing__(self, word: bytes) -> int:
        got = self.digest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = got
        return got

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def of(self, made: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts end to end, and the number of words of each text."""
        arrays, sizes = [], np.zeros(len(made), np.int64)
        for i, text in enumerate(made):
            for piece in pieces(text):
                arrays.append(self.array(piece.split()))
                sizes[i] += len(arrays[-1])
        return (np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)), sizes


def word_hashes() -> WordHashes:
    return kept("words", WordHashes)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, element by element; order matters."""
    x = (a ^ (a >> np.uint64(32))) * _K1 + (b ^ (b >> np.uint64(29))) * _K2
    x ^= x >> np.uint64(31)
    x *= _K1
    return x ^ (x >> np.uint64(30))


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x moved ``by`` places to the front; the end is filled with zeros (mask it)."""
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out
