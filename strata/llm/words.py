"""Words, shingles and their hashes for many texts at once, in numpy.

A word is a run of bytes that are none of 0x20 and 0x09 to 0x0D. All arrays
are over one Arrow batch; nothing here is per word in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if texts.type in (pa.large_string(), pa.large_binary()) else pa.binary()
    texts = texts.cast(kind).fill_null(b"")
    _, offs, data = texts.buffers()
    wide = np.int64 if kind == pa.large_binary() else np.int32
    o = np.frombuffer(offs, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


@dataclass
class Words:
    """buf: the words in order, one space after each; word i is buf[start[i]:end[i]]; text t has words first[t] to first[t + 1]."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def joined(self, t: int) -> bytes:
        """Text t with one space between words."""
        a, b = self.first[t], self.first[t + 1]
        return self.buf[self.start[a] : self.end[b - 1]].tobytes() if b > a else b""


def split(data: np.ndarray, offs: np.ndarray, fold: bool = False) -> Words:
    """fold: A-Z to lower case."""
    n = len(data)
    space = SPACE[data]
    word = ~space
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begins = word.copy()
    begins[1:] &= space[:-1] | edge[1:n]
    ends = word.copy()
    ends[:-1] &= space[1:] | edge[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = e - s
    stop = np.cumsum(size + 1)
    buf = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    put = np.ones(len(buf), bool)
    put[stop - 1] = False
    kept = data[word]
    buf[put] = FOLD[kept] if fold else kept
    return Words(buf, stop - 1 - size, stop - 1, np.searchsorted(s, offs))


def of(texts: pa.Array, fold: bool = False) -> Words:
    return split(*raw(texts), fold=fold)


_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, U), "q": np.ones(1, U)}
_RND = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_B = 0x9E3779B97F4A7C15
_BI = pow(_B, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for k, b in (("p", _B), ("q", _BI)):
            a = np.full(m, U(b))
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["q"]


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of buf[start:end] for many spans, from one running sum."""
    p, q = _powers(len(buf) + 1)
    run = np.empty(len(buf) + 1, U)
    run[0] = 0
    np.cumsum(_RND[buf] * p[: len(buf)], out=run[1:])
    return mix((run[end] - run[start]) * q[start] + (end - start).astype(U) * P5)


def window_hash(words: np.ndarray, k: int, salt: int = 1) -> np.ndarray:
    """Hash of every k consecutive word hashes, at their first word; k - 1 shorter than words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.zeros(n, U)
    m = U((0xD6E8FEB86659FD93 * (2 * salt + 1)) % 2**64)
    for j in range(k):
        h *= m
        h += words[j : j + n]
    return mix(h + U(salt))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc, x):
    return _rot(acc + x * P2, 31) * P1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[start:end] for many spans."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    r64 = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    r32 = np.ndarray((len(buf) + 1,), "<u4", padded, strides=(1,))
    at, left, seed = start.astype(np.int64), (end - start).astype(np.int64), U(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(at), seed + P5, U)
        i = np.flatnonzero(left >= 32)
        if len(i):
            v = [np.full(len(i), x, U) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            p, todo = at[i], left[i] // 32
            live = np.arange(len(i))
            while len(live):
                for k in range(4):
                    v[k][live] = _round(v[k][live], r64[p[live] + 8 * k])
                p[live] += 32
                todo[live] -= 1
                live = live[todo[live] > 0]
            x = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for k in range(4):
                x = (x ^ _round(U(0), v[k])) * P1 + P4
            h[i] = x
        h += left.astype(U)
        at = at + (left & ~31)
        left = left & 31
        for k in range(3):
            i = slice(None) if k == 0 and (left >= 8).all() else np.flatnonzero(left >= 8 * (k + 1))
            p = at[i] + 8 * k
            if len(p):
                h[i] = _rot(h[i] ^ _round(U(0), r64[p]), 27) * P1 + P4
        at += left & ~7
        left = left & 7
        i = np.flatnonzero(left >= 4)
        if len(i):
            h[i] = _rot(h[i] ^ (r32[at[i]].astype(U) * P1), 23) * P2 + P3
            at[i] += 4
        left = left & 3
        for k in range(3):
            i = np.flatnonzero(left > k)
            if len(i):
                h[i] = _rot(h[i] ^ (padded[at[i] + k].astype(U) * P5), 11) * P1
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        h ^= h >> U(32)
    return h


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word and text of every k-word shingle; a text of 1 to k - 1 words has one, the whole."""
    per = np.where(w.counts >= k, w.counts - k + 1, np.minimum(w.counts, 1))
    doc = np.repeat(np.arange(len(per)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    a = w.first[:-1][doc] + nth
    return a, np.minimum(a + k, w.first[1:][doc]) - 1, doc


def chunked(texts: pa.Array, limit: int = 500_000):
    """Slices of an array of texts, about limit bytes each (one text at least)."""
    if not len(texts):
        return
    _, offs = raw(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, texts.slice(i, j - i)
        i = j
