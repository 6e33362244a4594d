"""Word shingles of texts as sorted arrays of 64-bit hashes, and packed integer arrays."""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard

WORDS = 5
# Distinct words whose hashes a worker remembers: about 20 MB.
_REMEMBERED = 100_000
_MULTIPLIERS = tuple(np.uint64(xxhash.xxh64_intdigest(bytes([place])) | 1) for place in range(WORDS))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        # The frequent words come early; those met later are worked out each time.
        if len(self) < _REMEMBERED:
            self[word] = value
        return value


_hashes = _WordHashes()


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MULTIPLIERS[0]
    return values ^ (values >> np.uint64(29))


def word_codes(words: list[bytes]) -> np.ndarray:
    """The 64-bit hash of each word."""
    return np.array(list(map(_hashes.__getitem__, words)), np.uint64)


def shingle_set(text: str, width: int = WORDS) -> np.ndarray:
    """The distinct shingles of ``width`` words of a text, sorted; a shorter text is one shingle, one without words none.

    Words are what stands between ASCII white space, with A-Z lower-cased: ``bytes.lower`` and ``bytes.split``
    know exactly those characters.
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = word_codes(words)
    if len(words) < width:
        # Shorter texts hash the number of words as well, so that they never meet a longer one.
        value = np.uint64(len(words))
        for code in codes:
            value = mixed(np.array([value ^ code], np.uint64))[0]
        return np.array([value], np.uint64)
    size = len(words) - width + 1
    values = np.zeros(size, np.uint64)
    for place in range(width):
        values = mixed(values ^ (codes[place : place + size] * _MULTIPLIERS[place]))
    return np.unique(values)


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit hash of a whole set."""
    digest = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), "<i8")
    return int(digest[0]), int(digest[1])


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed; planes of high bytes are nearly free."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def packed_rising(values: np.ndarray) -> bytes:
    """Sorted unsigned integers, as the steps between them."""
    return packed(np.diff(values, prepend=np.zeros(1, values.dtype)))


def unpacked_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)
