"""Keyed Feistel permutations of [0, n) by cycle-walking, over numpy arrays."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    with np.errstate(over="ignore"):
        x = x + _U(key & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def round_keys(key: int, rounds: int = 4) -> list[int]:
    seed, keys = np.array([key & 0xFFFFFFFFFFFFFFFF], _U), []
    for i in range(rounds):
        seed = _mix(seed, 0x9E3779B97F4A7C15 * (i + 1))
        keys.append(int(seed[0]))
    return keys


def permute(index: np.ndarray, n: np.ndarray | int, key: int | np.ndarray = 0) -> np.ndarray:
    """The place of each index under the permutation of [0, n) that key names; n and key may differ from index to index.

    A balanced Feistel network permutes the smallest power of four that holds n; a result
    outside [0, n) is put through it again, which ends since the network is a bijection.
    """
    x = np.array(index, _U)
    size = np.broadcast_to(np.asarray(n, _U), x.shape)
    if x.size == 0:
        return x.astype(np.int64)
    tweak = np.broadcast_to(np.asarray(key, _U), x.shape)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size.astype(float), 2))).astype(np.int64) + 1) // 2).astype(_U)
    # log2 of huge n may round down
    half = np.where((half < _U(32)) & (_U(1) << np.minimum(_U(2) * half, _U(63)) < size), half + _U(1), half)
    mask = (_U(1) << half) - _U(1)
    todo = np.arange(x.size)
    keys = round_keys(0x5EED)
    while todo.size:
        h, m, t = half[todo], mask[todo], tweak[todo]
        left, right = x[todo] >> h, x[todo] & m
        for k in keys:
            left, right = right, left ^ (_mix(_mix(right, k) ^ t, k) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= size[todo]]
    return x.astype(np.int64)
