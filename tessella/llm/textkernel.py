"""Numpy kernels over Arrow text buffers, used inside Spark tasks.

Texts are read as UTF-8 bytes straight from the Arrow buffers, in pieces of
bounded size, so that no Python string is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240229)
#: A random odd number for each byte value, and the base of the polynomial.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15 | 1)
#: Bytes of a word up to which the polynomial tells words apart; longer ones get a cryptographic hash.
LONGEST_POLYNOMIAL = 32
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters, and every byte of a non-ASCII character.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def powers(n: int, sign: int = 1) -> np.ndarray:
    """BASE**i (or BASE**-i) for i < n, modulo 2**64."""
    if len(_powers.get(sign, ())) < n:
        steps = np.full(max(n, 1 << 16), BASE if sign > 0 else U64(pow(int(BASE), -1, 2**64)), dtype=U64)
        steps[0] = 1
        _powers[sign] = np.multiply.accumulate(steps)
    return _powers[sign][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def pieces(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about ``limit`` bytes; a longer row is a piece of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and 64-bit hashes of lower-cased words, and the index of the first word of each row (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    inside = IN_WORD[low]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    opens[first] = inside[first]
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = span_hashes(prefix(low), starts, ends)
    # a polynomial modulo a power of two has built collisions between long words, whatever its base
    for k in np.flatnonzero(ends - starts > LONGEST_POLYNOMIAL).tolist():
        hashes[k] = U64(int.from_bytes(hashlib.blake2b(low[starts[k] : ends[k]], digest_size=8).digest(), "little"))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def prefix(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums, for hashes of any span."""
    out = np.zeros(len(data) + 1, dtype=U64)
    values = BYTE_VALUE[data]
    values *= powers(len(data))
    np.cumsum(values, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums), sign=-1)[starts])


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each row; a row of fewer words, but not none, is one gram."""
    m = len(hashes)
    grams = np.zeros(max(0, m - n + 1), dtype=U64)
    for k in range(n):
        grams *= BASE
        grams += hashes[k : k + len(grams)]
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            short = np.array([b - a], dtype=U64)
            for h in hashes[a:b]:
                short = short * BASE + h
            out.append(mix(short))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` neighbours (block prefix and suffix minima)."""
    n = len(x)
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]) if pad else x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
