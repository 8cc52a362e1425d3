"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Lengths are whole numbers of at most `capacity`, so the instance is a histogram
of at most `capacity` counts whatever the corpus's size; only that histogram
comes to the driver. There, in this order:

* full pieces are their own sequences;
* two pieces that fill a sequence exactly are fixed together;
* for the longest piece left, it is fixed alone where nothing else fits, or with
  its largest partner k where no set of others that fits dominates {it, k}: no
  two fit beside it, or no three do and no two are longer together than k;
* the rest goes best-fit in falling length, whole groups of equal bins at once.

A plan is a list of groups (pattern, how many sequences). It has at most about
3 groups for each length, and a pattern at most sqrt(2 capacity) runs, so what
is broadcast has a bound that doesn't depend on the data (under 90 MB at 4,096,
about 1 MB in practice). A piece finds its sequence by its rank among pieces of
its length; ranks are counted in hashed chunks, so a length that a third of all
pieces have is split too.

Null text is empty; repeated rows are packed once each; an empty table gives no
rows.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import words as W
from strata.llm.runtime import CACHES, lean, plain, prepare, table

CAPACITY, END = 4096, 1
CACHE_UNITS, LEARN = 2_000_000, 4096
#: Fixed value: the pre-tokenizer's pattern whose matches never need to be looked at together.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENCODERS: dict[str, Encoder] = {}
CACHES["encoder"] = _ENCODERS.clear
_KIND = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 sign, 4 part of a wide character
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[128:] = 4


class _Known:
    """Units that were encoded: sorted hashes, each with its ids' place and number in a pool."""

    def __init__(self):
        self.base = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.late = self.base
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def __len__(self) -> int:
        return len(self.base[0]) + len(self.late[0])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int32)
        for keys, places, sizes in (self.base, self.late):
            if len(keys):
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[i] == h
                at[hit], n[hit] = places[i[hit]], sizes[i[hit]]
        return at, n

    def add(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool) // 2), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.late = _sorted(self.late, (h, self.used + np.cumsum(n) - n, n))
        self.used += len(ids)
        if len(self.late[0]) > max(50_000, len(self.base[0]) // 4):
            self.base, self.late = _sorted(self.base, self.late), tuple(x[:0] for x in self.base)

    def ids(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        stop = np.cumsum(n, dtype=np.int64)
        return self.pool[np.repeat(at - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]


class Encoder:
    """Token ids of many texts: each distinct unit is encoded once.

    A unit is a word, as the tokenizers meant here never look across white space. Where the pre-tokenizer has the
    pattern UNITS a word is cut further, at places where every match ends and no character composes with the
    one before: before an ASCII digit, and where an ASCII sign and an ASCII letter or digit meet (a letter after an
    apostrophe stays with it); and A-Z before an ASCII byte are folded where the normalizer folds. Words that may hold a
    special token stay whole.

    Units are known by 64-bit hashes, in two generations of CACHE_UNITS / 2: one that is met again moves to the
    new generation, so a full cache forgets what is rare and not what is frequent.
    """

    def __init__(self, path: str, cache: int = CACHE_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.new, self.old, self.encoded = cache // 2, _Known(), _Known(), 0
        told = json.loads(Path(path).read_text())
        self.fine = json.dumps(UNITS) in json.dumps(told.get("pre_tokenizer"))
        self.fold = '"Lowercase"' in json.dumps(told.get("normalizer"))
        self.special = sorted({x["content"].lower().encode()[:2] for x in told.get("added_tokens") or [] if x["content"]})

    @staticmethod
    def at(path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def units(self, w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, first and last + 1 of each unit, and the first unit of each word and one more."""
        if not self.fine or not len(w.start):
            return w.buf, w.start, w.end, np.arange(len(w.start) + 1)
        buf, kind = w.buf, _KIND[w.buf]
        before, was = np.zeros_like(kind), np.full_like(buf, 32)
        before[1:], was[1:] = kind[:-1], buf[:-1]
        cut = (kind == 2) | ((kind < 4) & (before < 4) & (kind != before) & ((was != 39) | (kind != 1)))
        low = W.FOLD[buf]
        fold = np.full(len(buf), self.fold)
        fold[:-1] &= buf[1:] < 128
        for x in self.special:
            hit = low == x[0]
            if len(x) > 1:
                hit[:-1] &= low[1:] == x[1]
            for i in np.unique(np.searchsorted(w.start, np.flatnonzero(hit), "right") - 1).tolist():
                cut[w.start[i] : w.end[i]] = fold[w.start[i] : w.end[i]] = False
        buf = np.where(fold, low, buf)
        cut &= kind != 0
        cut[w.start] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(buf))
        end -= buf[end - 1] == 32
        return buf, start, end, np.append(np.searchsorted(start, w.start), len(start))

    def _learn(self, h: np.ndarray, texts: list[str]) -> None:
        for i in range(0, len(texts), LEARN):  # an encoding is a large object, so only so many at once
            got = [x.ids for x in self.tokenizer.encode_batch_fast(texts[i : i + LEARN], add_special_tokens=False)]
            n = np.fromiter(map(len, got), np.int32, len(got))
            self.new.add(h[i : i + LEARN], np.fromiter((i for x in got for i in x), np.uint32, int(n.sum())), n)
        self.encoded += len(texts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each text's followed by END, and the number for each text."""
        w = W.of(texts)
        buf, start, end, first_unit = self.units(w)
        distinct, first, which = np.unique(W.span_hash(buf, start, end), return_index=True, return_inverse=True)
        at, n = self.new.find(distinct)
        lost = np.flatnonzero(at < 0)
        if len(self.new) + len(lost) > self.most:
            self.new, self.old = _Known(), self.new
            lost = np.arange(len(distinct))
        if len(lost):
            old_at, old_n = self.old.find(distinct[lost])
            kept = old_at >= 0
            self.new.add(distinct[lost[kept]], self.old.ids(old_at[kept], old_n[kept]), old_n[kept])
            lost = lost[~kept]
            if len(lost):
                data = buf.tobytes()
                self._learn(distinct[lost], [data[i:j].decode() for i, j in zip(start[first[lost]].tolist(), end[first[lost]].tolist(), strict=True)])
            at, n = self.new.find(distinct)
        n_unit = n[which].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n_unit)])
        edge = first_unit[w.first]
        per = total[edge[1:]] - total[edge[:-1]] + 1
        ids = np.full(int(per.sum()), END, np.uint32)
        to = np.arange(total[-1]) + np.repeat(np.arange(len(per)), per - 1)
        ids[to] = self.new.ids(at[which], n_unit)
        return ids, per


def _sorted(a: tuple, b: tuple) -> tuple:
    both = [np.concatenate(x) for x in zip(a, b, strict=True)]
    order = np.argsort(both[0], kind="stable")
    return tuple(x[order] for x in both)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and END, cut only beyond capacity."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer)
        for b in batches:
            for i, part in W.chunked(b.column(1)):
                own, per = encoder.encode(part)
                cuts = -(-per // capacity)
                doc = np.repeat(np.arange(len(per)), cuts)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                size = np.minimum(per[doc] - nth * capacity, capacity)
                stop = np.cumsum(size)
                data = memoryview(own.astype("<u4").tobytes())
                sums = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip((stop - size).tolist(), stop.tolist(), strict=True)]
                cols = [b.column(0).take(pa.array(doc + i)), pa.array(nth.astype(np.int32)), pa.array(nth * capacity), pa.array(size), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(own.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return plain(docs, "doc_id", "text").mapInArrow(lean(run, "encoder"), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


Pattern = tuple[tuple[int, int], ...]  # (length, how many), in the order of their places


def reduce_(count: dict[int, int], c: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets and take them out of count."""
    out: list[tuple[Pattern, int]] = []

    def fix(n: int, *lengths: int) -> None:
        if n > 0:
            out.append((tuple((s, 1) for s in lengths), n))
            for s in lengths:
                count[s] -= n
                if not count[s]:
                    del count[s]

    fix(count.get(c, 0), c)
    for s in sorted(count, reverse=True):
        if s > c - s:
            fix(min(count[s], count.get(c - s, 0)), s, c - s)
        elif 2 * s == c and count[s] > 1:
            n = count[s] // 2
            out.append((((s, 2),), n))
            count[s] -= 2 * n
            if not count[s]:
                del count[s]
    for j in sorted(count, reverse=True):
        while count.get(j):
            others = sorted(count)
            free = lambda s: count.get(s, 0) - (s == j)  # noqa: B023, E731
            small = []
            for s in others:
                small += [s] * min(3 - len(small), free(s))
                if len(small) == 3:
                    break
            room = c - j
            if not small or small[0] > room:
                fix(count[j], j)
                continue
            k = max(s for s in others if s <= room and free(s) > 0)
            if len(small) > 2 and sum(small) <= room:
                break  # three fit: sets of more than three would have to be searched
            if len(small) > 1 and small[0] + small[1] <= room:
                best, lo, hi = 0, 0, len(others) - 1
                while lo <= hi:
                    a, z = others[lo], others[hi]
                    if a + z > room or free(z) < 1 + (a == z):
                        hi -= 1
                    elif free(a) < 1:
                        lo += 1
                    else:
                        best, lo = max(best, a + z), lo + 1
                if best > k:
                    break
                fix(1, j, k)  # which pairs there are may change with each
                continue
            if k == j:
                n = count[j] // 2
                out.append((((j, 2),), n))
                count[j] -= 2 * n
                if not count[j]:
                    del count[j]
            else:
                fix(min(count[j], count[k]), j, k)
    return out


def best_fit(count: dict[int, int], c: int) -> list[tuple[Pattern, int]]:
    """Best-fit in falling length; bins alike in content are one group."""
    room: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    live: list[int] = []
    import bisect

    def put(r: int, p: Pattern, n: int) -> None:
        if n:
            if not room[r]:
                bisect.insort(live, r)
            room[r].append((p, n))

    for s in sorted(count, reverse=True):
        n = count[s]
        while n:
            i = bisect.bisect_left(live, s)
            if i == len(live):
                q = min(c // s, n)
                k = n // q
                put(c - q * s, ((s, q),), k)
                n -= k * q
                continue
            r = live[i]
            p, k = room[r].pop()
            if not room[r]:
                live.pop(i)
            q = min(r // s, n)
            m = min(k, n // q)
            put(r, p, k - m)
            put(r - q * s, (*p, (s, q)), m)
            n -= m * q
    return [x for group in room.values() for x in group]


def plan(count: dict[int, int], c: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, sequences, offset), sorted by length and rank.

    The piece of rank r in a row has sequence first + (r - first rank) mod sequences
    and offset + length * ((r - first rank) div sequences).
    """
    left = {int(s): int(n) for s, n in count.items() if n}
    groups = reduce_(left, c)
    groups += best_fit(left, c)
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in groups:
        at = 0
        for s, q in pattern:
            rows.append((s, rank[s], q * n, sequence, n, at))
            rank[s] += q * n
            at += q * s
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for the rows of :func:`pieces`, which must not change when they are read again."""
    spark = cut.sparkSession
    hist = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # capacity rows at most
    rows = plan({r["length"]: r["n"] for r in hist}, capacity)
    sent = spark.sparkContext.broadcast(rows)
    chunks = max(8, math.ceil(sum(r["n"] for r in hist) / 100_000))
    own = cut.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    before = own.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    before = before.select("length", "_chunk", (F.sum("_n").over(Window.partitionBy("length").orderBy("_chunk")) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = own.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["length", "_chunk"])
    ranked = ranked.select(*cut.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))
    names = [*cut.columns, "sequence_id", "offset"]
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        wide = np.int64(1) << 40
        starts = p[:, 0] * wide + p[:, 1]
        for b in batches:
            size, rank = (b.column(i).to_numpy() for i in (at_length, at_rank))
            row = p[np.searchsorted(starts, size * wide + rank, "right") - 1]
            r = rank - row[:, 1]
            cols = [b.column(i) for i in range(b.num_columns) if i != at_rank]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row[:, 3] + r % row[:, 4]), pa.array(row[:, 5] + size * (r // row[:, 4]))], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(lean(run), f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and place there; ids: with its token ids."""
    return assign(table(pieces(docs, tokenizer, capacity, ids), "pieces"), capacity)
