"""Vectorised splitting and hashing of words over many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C55)
#: Coefficients of the words of a window; odd, fixed.
COEF = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)

#: Bytes of words that white space parts: all but 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words of digits, lower-case letters and whatever isn't ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** i for i < n, modulo 2 ** 64."""
    global _powers
    if n > len(_powers):
        grown = np.full(max(n, 64, 2 * len(_powers)), BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; numpy's own way hashes them, which is far slower where most differ."""
    values = np.sort(values)
    return values[np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))]


def join_texts(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a line feed, and the offsets of texts (one more than texts)."""
    texts = list(texts)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8), offsets


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and lengths of all words, and for each text the index of its first word (one more than texts)."""
    inside = is_word[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]  # the last byte is a line feed, so every word ends
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64), starts, lengths, np.zeros(len(offsets), np.int64)
    first = np.cumsum(lengths) - lengths
    own = data[inside].astype(np.uint64)
    at = np.arange(len(own)) - np.repeat(first, lengths)
    own += np.uint64(1)
    own *= powers(int(lengths.max()) + 1)[at]
    return mix(np.add.reduceat(own, first)), starts, lengths, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size words from each position on; the last size - 1 positions are missing."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, size, dtype=np.uint64) * BASE
    for i in range(size):
        c = COEF[i % len(COEF)] + np.uint64(i // len(COEF) * 0x51ED2702)
        out += mix(hashes[i : i + n] * c) if i else hashes[:n] * c
    return mix(out)


def chunks(batches: Iterable, text: str = "text", limit: int = 1 << 18) -> Iterator[tuple[object, list[bytes]]]:
    """Record batches cut so that their texts have about limit bytes; null texts come as empty ones."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        own = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]
        start = total = 0
        for i, x in enumerate(own):
            total += len(x)
            if total >= limit or i + 1 == len(own):
                yield batch.slice(start, i + 1 - start), own[start : i + 1]
                start, total = i + 1, 0
