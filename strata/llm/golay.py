"""The perfect binary Golay code of length 23: decoding, and the keys that make it a fuzzy hash.

Every 23-bit word is at most 3 bits from exactly one of the 4,096 codewords.
decode(v) is that codeword's index; keys(v) holds decode of v and of each of
its 23 neighbours: one key where v is within 2 bits of its codeword, six where
it is 3 away. So u and v at distance 0 or 1 have decode(u) in keys(v) and
decode(v) in keys(u).
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, POLY = 23, 0b101011100011


@cache
def decode_table() -> np.ndarray:
    """Codeword index of each of the 2**23 words, from its syndrome."""
    syndrome = np.zeros(LENGTH, np.int64)
    for i in range(LENGTH):
        v = 1 << i
        for b in range(22, 10, -1):
            if v >> b & 1:
                v ^= POLY << (b - 11)
        syndrome[i] = v
    error = np.zeros(2048, np.int64)
    for n in range(1, 4):
        for at in combinations(range(LENGTH), n):
            error[np.bitwise_xor.reduce(syndrome[list(at)])] = sum(1 << i for i in at)
    v = np.arange(1 << LENGTH, dtype=np.int32)
    s = np.zeros(1 << LENGTH, np.int16)
    for i in range(LENGTH):
        s ^= ((v >> i & 1) * syndrome[i]).astype(np.int16)
    # a cyclic code in systematic form: the upper 12 bits name the codeword
    return ((v ^ error.astype(np.int32)[s]) >> 11).astype(np.int16)


def keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and key, each pair once."""
    t = decode_table()
    got = np.empty((len(v), LENGTH + 1), np.int16)
    got[:, 0] = t[v]
    for i in range(LENGTH):
        got[:, i + 1] = t[v ^ (1 << i)]
    got.sort(axis=1)
    new = np.ones(got.shape, bool)
    new[:, 1:] = got[:, 1:] != got[:, :-1]
    return np.nonzero(new)[0], got[new].astype(np.int64)
