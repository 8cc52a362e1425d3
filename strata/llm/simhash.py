"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. If two
fingerprints differ in at most 3 bits, then of some two segments each differs
in at most one bit (drop the segment with most errors). For each of the three
pairs of segments (i, j) a fingerprint u is filed twice, as a left key
(keys(u_i), decode(u_j)) and as a right key (decode(u_i), keys(u_j)); by the
property of :mod:`strata.llm.golay` u's left key and v's right key then meet.
That is about 32 rows of 16 bytes for each distinct fingerprint and none for
its copies. Within one 24-bit key every link is verified on all 64 bits, and a
breadth-first search keeps only a spanning forest of the links, so a dense
group gives one link less than its members and no pair of groups is lost.

Null and empty texts have fingerprint zero; a null doc_id is kept, and is never
a component's id unless it has no other. Repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import golay
from strata.llm import words as W
from strata.llm.components import components
from strata.llm.runtime import CACHES, lean, parts, plain, prepare, table

SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
MAX_BITS = 3
CACHES["golay"] = golay.decode_table.cache_clear
_BYTE = np.array([sum((b >> i & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def majority(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """One 64-bit value for each run of per[t] hashes: the bits set in over half of them; 0 for an empty run."""
    out = np.zeros(len(per), np.uint64)
    full = np.flatnonzero(per > 0)
    if not len(full):
        return out
    n = per[full]
    begin = np.cumsum(n) - n
    # 255 hashes at most are added in byte lanes before they are widened
    blocks = -(-n // 255)
    first = np.cumsum(blocks) - blocks
    at = np.repeat(begin, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    bytes_ = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.zeros((len(full), 64), bool)
    for j in range(8):
        lanes = np.add.reduceat(_BYTE[bytes_[:, j]], at).astype("<u8").view(np.uint8).reshape(-1, 8)
        bits[:, 8 * j : 8 * j + 8] = 2 * np.add.reduceat(lanes.astype(np.int64), first, axis=0) > n[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints_of(texts: pa.Array, k: int = 3, distinct: bool = False, seed: int = 42) -> np.ndarray:
    """SimHash of each text over its k-word shingles, A-Z folded; distinct: each shingle counts once."""
    out = []
    for _, part in W.chunked(texts):
        w = W.of(part, fold=True)
        a, b, doc = W.shingles(w, k)
        h = W.xxh64(w.buf, w.start[a], w.end[b], seed)
        if distinct and len(h):
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
        out.append(majority(h, np.bincount(doc, minlength=len(part))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, views: tuple[tuple[int, bool, int], ...] = ((3, False, 42),)) -> DataFrame:
    """(doc_id, fp_0, fp_1, ...): a fingerprint as a signed long for each view (k, distinct, seed)."""
    names = [f"fp_{i}" for i in range(len(views))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [pa.array(fingerprints_of(b.column(1), *v).view(np.int64)) for v in views]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    prepare(docs.sparkSession)
    return plain(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{n} long" for n in names))


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and key of every filing of the fingerprints."""
    seg = [(fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [golay.decode_table()[s].astype(np.int64) for s in seg]
    many = [golay.keys(s) for s in seg]
    rows, out = [], []
    for p, (i, j) in enumerate(PAIRS):
        r, k = many[i]
        rows.append(r)
        out.append(p << 24 | k << 12 | own[j][r])
        r, k = many[j]
        rows.append(r)
        out.append(p << 24 | own[i][r] << 12 | k)
    return np.concatenate(rows), np.concatenate(out)


def forest(fp: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph that joins fingerprints at most bits apart; positions in fp."""
    rest, out = np.arange(len(fp)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[u]) <= bits
            if near.any():
                got = rest[near]
                out += [(int(u), int(v)) for v in got]
                queue += got.tolist()
                rest = rest[~near]
    return out


def _bucket_links(key: np.ndarray, fp: np.ndarray, every: bool = False) -> Iterator[np.ndarray]:
    """Pairs of fingerprints in one key's run and near; rows are sorted by key, then fingerprint. every: all pairs of small runs."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])  # filed left and right under one key
    key, fp = key[new], fp[new]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    size = np.diff(np.append(begin, len(key)))
    for n in range(2, 9):  # runs of a few members, all of one size at once
        at = begin[size == n]
        if len(at):
            for i in range(n):
                for j in range(i + 1, n):
                    a, b = fp[at + i], fp[at + j]
                    near = np.bitwise_count(a ^ b) <= MAX_BITS
                    yield np.stack([a[near], b[near]])
    for at, n in zip(begin[size > 8], size[size > 8], strict=True):
        run = fp[at : at + n]
        if links := forest(run):
            ij = np.array(links).T
            yield run[ij]


def links(prints: DataFrame, fp: str) -> DataFrame:
    """(a, b): links between distinct fingerprints at most MAX_BITS apart, each component of a key's run spanned."""
    n = parts(prints.sparkSession)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(v), 20_000):
                part = v[i : i + 20_000]
                r, k = golay_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[r].view(np.int64))], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, size = [], [], 0

        def flush(k, f):
            got = list(_bucket_links(k, f.view(np.uint64)))
            a = np.concatenate(got, axis=1) if got else np.zeros((2, 0), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in np.ascontiguousarray(a)], ["a", "b"])

        for b in batches:
            key.append(b.column(0).to_numpy())
            fp.append(b.column(1).to_numpy())
            size += len(b)
            if size >= 200_000:
                k, f = np.concatenate(key), np.concatenate(fp)
                cut = int(np.searchsorted(k, k[-1]))  # the last key may go on
                if cut:
                    yield flush(k[:cut], f[:cut])
                key, fp, size = [k[cut:]], [f[cut:]], len(k) - cut if cut else 0
        if key:
            yield flush(np.concatenate(key), np.concatenate(fp))

    keys = prints.select(F.col(fp).alias("fp")).distinct().mapInArrow(lean(file, "golay"), "key long, fp long")
    met = keys.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(lean(meet), "a long, b long")
    return met.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text)."""
    prints = table(fingerprints(docs), "prints")
    roots = components(links(prints, "fp_0"), "a", "b")
    own = prints.groupBy("fp_0").agg(F.min("doc_id").alias("low")).join(roots.withColumnRenamed("node", "fp_0"), "fp_0", "left")
    own = own.select("fp_0", "low", F.coalesce("root", "fp_0").alias("root"))
    low = own.groupBy("root").agg(F.min("low").alias("component_id"))
    named = own.join(low, "root").select("fp_0", "component_id")
    return prints.join(named, "fp_0").select("doc_id", F.lpad(F.lower(F.hex("fp_0")), 16, "0").alias("fingerprint"), "component_id")
