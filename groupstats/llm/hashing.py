"""XXH64 of many slices of a byte array at once."""

from __future__ import annotations

import numpy as np

#: Primes of the XXH64 function (fixed values).
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned hashes of ``data[start : start + size]``."""
    with np.errstate(over="ignore"):
        padded = np.concatenate([data, np.zeros(32, np.uint8)])
        lanes = np.ndarray((len(data) + 24,), "<u8", padded, strides=(1,))
        halves = np.ndarray((len(data) + 24,), "<u4", padded, strides=(1,))
        s = np.uint64(seed)
        h = np.full(len(starts), s + P5)
        place = starts.astype(np.int64)
        stripes = sizes // 32
        long = np.flatnonzero(stripes)
        if len(long):
            long = long[np.argsort(-stripes[long], kind="stable")]
            count = stripes[long]
            v = [np.full(len(long), x) for x in (s + P1 + P2, s + P2, s, s - P1)]
            for step in range(int(count[0])):
                k = int(np.searchsorted(-count, -step, side="left"))
                at = place[long[:k]] + 32 * step
                for lane in range(4):
                    v[lane][:k] = _round(v[lane][:k], lanes[at + 8 * lane])
            total = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for lane in v:
                total = (total ^ _round(np.zeros_like(lane), lane)) * P1 + P4
            h[long] = total
        h += sizes.astype(np.uint64)
        place = place + 32 * stripes
        rest = sizes % 32
        for step in range(3):
            some = np.flatnonzero(rest >= 8 * (step + 1))
            if not len(some):
                break
            lane = lanes[place[some] + 8 * step]
            h[some] = _turn(h[some] ^ _round(np.zeros_like(lane), lane), 27) * P1 + P4
        place = place + rest // 8 * 8
        rest = rest % 8
        some = np.flatnonzero(rest >= 4)
        h[some] = _turn(h[some] ^ halves[place[some]].astype(np.uint64) * P1, 23) * P2 + P3
        place[some] += 4
        rest = rest % 4
        for step in range(3):
            some = np.flatnonzero(rest > step)
            h[some] = _turn(h[some] ^ padded[place[some] + step].astype(np.uint64) * P5, 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))
