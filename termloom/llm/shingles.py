"""Word shingles of a text as sets of 64-bit numbers, made with NumPy for a whole text at a time."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MASK = (1 << 64) - 1
_factors = np.empty(0, _U)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 (a bijection, so it adds no collision)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _factors_to(n: int) -> np.ndarray:
    """A pseudo-random factor for each place of a word, made further as longer words come."""
    global _factors
    if len(_factors) < n:
        _factors = mix(np.arange(1, 2 * n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(0xD1B54A32D192ED03))
    return _factors


def word_numbers(text: bytes) -> np.ndarray:
    """A 64-bit number for every word [^\\x20\\x09-\\x0D]+ of UTF-8 text, A-Z lower-cased, in order.

    Multilinear: each byte times the factor of its place in the word, summed, and the length. Two words differ in a sum of
    byte differences times independent factors, which is 0 with probability 2**-57 at most, whatever the words are (a
    polynomial modulo 2**64 isn't so: Thue-Morse words agree under every base)."""
    raw = np.frombuffer(text.lower(), np.uint8)  # bytes.lower() touches A-Z alone
    n = len(raw)
    if not n:
        return np.empty(0, _U)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, _U)
    size = end - start
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=first[1:])
    letters = raw[inside[1:-1].view(bool)].astype(_U)
    factors = _factors_to(int(size.max()))
    letters += _U(1)
    letters *= factors[np.arange(len(letters)) - np.repeat(first[:-1], size)]
    return mix(np.add.reduceat(letters, first[:-1]) + mix(size.astype(_U)))


def shingle_set(text: bytes | None, width: int = 2) -> np.ndarray:
    """Sorted distinct numbers of the width-word shingles; a shorter text is one shingle; no words, no shingle."""
    words = word_numbers(text or b"")
    if not len(words):
        return words
    width = min(width, len(words))
    out = words[: len(words) - width + 1].copy()
    for k in range(1, width):
        out = mix(out * _U(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k])
    return np.unique(out + _U(width))


def universal(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and shifts of multiply-add-shift hashing, a universal family on 32-bit keys."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, count, dtype=np.uint64) * _U(2) + _U(1)
    return a, rng.integers(0, 1 << 63, count, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of every hash over the set, as uint32."""
    keys = shingles >> _U(32)
    low = np.full(len(a), _MASK, _U)
    for at in range(0, len(keys), 256):
        part = np.multiply.outer(keys[at : at + 256], a)
        part += b
        np.minimum(low, part.min(axis=0), out=low)
    return (low >> _U(32)).astype(np.uint32)
