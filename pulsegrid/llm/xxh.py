"""XXH64 of many byte ranges at once: ranges of one length run through the same steps together, so no step needs a mask."""

from __future__ import annotations

import numpy as np
import xxhash

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Ranges longer than this are hashed one by one: they are rare, and a step in Python costs more than they.
LONG = 256


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def mixed(lane: np.ndarray) -> np.ndarray:
    return rotated(lane * P2, 31) * P1


def of_length(eight: np.ndarray, four: np.ndarray, one: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """The hashes of the ranges of ``length`` bytes that begin at ``at``; eight, four and one read so many bytes at any place."""
    s, at = np.uint64(seed), at.copy()
    if length >= 32:
        v = [np.full(len(at), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
        for _ in range(length // 32):
            for i in range(4):
                v[i] = rotated(v[i] + eight[at + 8 * i] * P2, 31) * P1
            at += 32
        h = rotated(v[0], 1) + rotated(v[1], 7) + rotated(v[2], 12) + rotated(v[3], 18)
        for x in v:
            h = (h ^ mixed(x)) * P1 + P4
    else:
        h = np.full(len(at), s + P5, np.uint64)
    h += np.uint64(length)
    for _ in range(length % 32 // 8):
        h = rotated(h ^ mixed(eight[at]), 27) * P1 + P4
        at += 8
    if length % 8 >= 4:
        h = rotated(h ^ four[at].astype(np.uint64) * P1, 23) * P2 + P3
        at += 4
    for _ in range(length % 4):
        h = rotated(h ^ one[at].astype(np.uint64) * P5, 11) * P1
        at += 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    return h ^ h >> np.uint64(32)


def hashes(data: bytes, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each data[start:end], unsigned."""
    padded = data + bytes(8)
    one = np.frombuffer(padded, np.uint8)
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    size = end - start
    order = np.argsort(np.minimum(size, LONG + 1).astype(np.uint16), kind="stable")
    short = order[: np.searchsorted(size[order] > LONG, True)]
    out = np.empty(len(start), np.uint64)
    edge = np.flatnonzero(np.diff(size[short], prepend=-1, append=-1))
    with np.errstate(over="ignore"):
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = short[a:b]
            out[own] = of_length(eight, four, one, start[own], int(size[own[0]]), seed)
    for i in order[len(short) :].tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]], seed)
    return out
