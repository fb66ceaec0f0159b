"""Vectorised hashing of words and byte strings for the Arrow-batched stages.

All hashes are 64-bit and fixed: the same bytes give the same value in every
task, executor and session.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U64 = np.uint64
#: Odd multipliers of the polynomial hash and of the finaliser.
BASE = 0x9E3779B97F4A7C15
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_INVERSE = pow(BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _M1
        x = (x ^ (x >> U64(27))) * _M2
        return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of BASE and of its inverse modulo 2**64, grown on demand."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, step in enumerate((BASE, _INVERSE)):
                factors = np.full(max(n, 1 << 16), step, U64)
                factors[0] = 1
                _powers[k] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def words_of(buffer: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes b with is_word[b]."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = is_word[np.frombuffer(buffer, np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


#: The longest word that is hashed by blocks of eight bytes; what is left of a last block counts.
_SHORT = 64
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def hash_words(buffer: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each byte range, for words: blocks are mixed one after another, long words go through BLAKE2b.

    Other seeds give independent hashes.
    """
    padded = np.frombuffer(buffer + bytes(8), np.uint8)
    blocks = np.ndarray(len(buffer) + 1, "<u8", padded, 0, (1,))  # eight bytes from each place on
    length = (ends - starts).astype(np.int64)
    with np.errstate(over="ignore"):
        h = mix(length.astype(U64) + U64(BASE) * U64(seed + 1))
        for k in range(0, _SHORT, 8):
            on = np.flatnonzero((length > k) & (length <= _SHORT))
            if not len(on):
                break
            h[on] = mix((h[on] ^ (blocks[starts[on] + k] & _LEFT[np.minimum(length[on] - k, 8)])) * U64(BASE))
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(length > _SHORT).tolist():
        h[i] = int.from_bytes(blake2b(buffer[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return h


def running_sums(buffer: bytes) -> np.ndarray:
    """Prefix sums of the polynomial hash; every range's hash is a difference of two."""
    power, _ = _power_tables(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[np.frombuffer(buffer, np.uint8)] * power[: len(buffer)], out=sums[1:])
    return sums


def hash_ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte range."""
    _, inverse = _power_tables(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * inverse[starts])


def hash_grams(sums: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width bytes at each position, good in its upper bits."""
    _, inverse = _power_tables(len(sums))
    with np.errstate(over="ignore"):
        return (sums[width:] - sums[:-width]) * inverse[: len(sums) - width] * _M1


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    out, w = values, 1
    while w * 2 <= width:
        out = np.minimum(out[:-w], out[w:])
        w *= 2
    return np.minimum(out[: len(out) - (width - w)], out[width - w :]) if w < width else out
