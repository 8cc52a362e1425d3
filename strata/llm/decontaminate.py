"""Benchmark leaks in documents: latent semantic retrieval, then subsequence and answer checks.

* Document frequencies of hashed words are counted over all documents.
* A randomised SVD by subspace iteration of TF-IDF passages gives RANK latent
  directions. Its rows are all benchmark items (weighted) and all passages of all
  documents, which weigh as much as PASSAGES of them where there are more; each round is a
  distributed product with A'A of which only a matrix of 2**BITS by RANK numbers
  comes to the driver. This fits the index; everything is then searched with it.
* Items' images in the latent space are filed in about sqrt(items) cells by spherical
  k-means. Every window of every document, at two lengths, is held against the cells'
  centres, and its TF-IDF vector by cosine against the items of the PROBES nearest cells
  alone. Windows at COSINE or more are candidates. A cell may be missed, and RANK
  directions hold less of each item as the benchmark grows, so these don't make
  the search complete:
* Places that a leak can't do without are found exactly, whatever the latent space
  holds. Any leak has PARAPHRASE of its item's words, so of the item's rarest ones,
  a few more than it may lack, it has some. These are counted in posting lists.
  Of leaks within REACH words, or twice the item's where that is more, none is missed.
* A candidate's neighbourhood is held against the item's words: it is a leak if
  their longest common subsequence is EXACT of the item's words, or PARAPHRASE
  of them with the item's last ANSWER words, its answer, in order and close by.

A benchmark of more than ITEM_BYTES is searched for in several passes over the documents, so what goes
to the driver and to the tasks has a bound.

Words are runs of bytes other than ASCII signs and white space, A-Z folded. Null
and empty texts leak nothing, a null doc_id is kept. Fewer than LEAST words in order
come by chance, so an item of SHORT to LEAST - 1 words is leaked only where all of them stand
in a row, and a shorter one only by a document that is nothing else. An item longer than
LONGEST is searched by its parts and checked as a whole.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import words as W
from strata.llm.runtime import lean, plain, prepare, release, table

BITS, RANK, ROUNDS, PASSAGES, WEIGHT = 14, 128, 2, 20_000, 4.0
STRIP, PACK, TASK = 8192, 64, 1 << 18  # passages that are multiplied at once, that a row holds, and that a task has
COSINE, EXACT, PARAPHRASE, ANSWER, LEAST, LONGEST = 0.25, 0.8, 0.6, 4, 8, 64
REACH, POSTINGS = 32, 1 << 20  # postings that are laid out at once
SHORT, ITEM_BYTES, PROBES = 4, 16 << 20, 4
BLOCK, SHAPES = 8, ((4, 24), (10, LONGEST))  # a window's blocks, and the longest item that it is for
_SIGN = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not chr(_b).isalnum():
        _SIGN[_b] = 32


def tokens(texts: pa.Array) -> tuple[W.Words, np.ndarray]:
    data, offs = W.raw(texts)
    w = W.split(_SIGN[data], offs, fold=True)
    return w, W.span_hash(w.buf, w.start, w.end)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def statistics(docs: DataFrame, sample: int | None = None) -> tuple[np.ndarray, int, DataFrame]:
    """In one pass over all documents: each word bucket's document frequency, the number of documents, and passages.

    Passages are runs of LONGEST words as buckets: all, PACK in a row as the bytes of their int16 numbers and of their
    sizes; or at most `sample` of them as arrays, evenly chosen by hash.
    """
    share = None
    if sample is not None:
        length = F.greatest(F.octet_length("text"), F.lit(1)) / F.lit(6.0 * LONGEST)
        some = docs.agg(F.sum(length).alias("n")).first()["n"] or 1.0  # passages, about
        share = np.uint64(min(2**64 - 1, int(min(1.0, 0.8 * sample / some) * 2**64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = np.zeros(1 << BITS, np.int64), 0
        names = ["bucket", "n", "mark", "words", "sizes"]
        for b in batches:
            for _, part in W.chunked(b.column(0)):
                w, h = tokens(part)
                bucket = _bucket(h)
                key = np.sort(w.doc() << BITS | bucket)
                key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
                n += np.bincount(key & (1 << BITS) - 1, minlength=1 << BITS)
                seen += len(part)
                per = -(-w.counts // LONGEST)
                nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                begin = np.repeat(w.first[:-1], per) + nth * LONGEST
                end = np.minimum(begin + LONGEST, np.repeat(w.first[1:], per))
                if share is not None and len(begin):
                    chosen = W.mix(h[begin] ^ h[end - 1] * np.uint64(3)) <= share
                    begin, end = begin[chosen], end[chosen]
                if not len(begin):
                    continue
                edge = np.concatenate([[0], np.cumsum(end - begin)])
                held = bucket[np.arange(edge[-1]) + np.repeat(begin - edge[:-1], end - begin)].astype(np.int16)
                if share is None:
                    cut = np.append(np.arange(0, len(begin), PACK), len(begin))
                    words, sizes = _packed(held, edge[cut]), _packed((end - begin).astype(np.uint8), cut)
                    mark = pa.nulls(len(words), pa.int64())
                else:
                    words, sizes = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(held)), pa.nulls(len(begin), pa.binary())
                    mark = pa.array(W.mix(h[begin]).view(np.int64))
                none = pa.nulls(len(words), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, mark, words, sizes], names)
        at = np.append(np.flatnonzero(n), -1)
        none = [pa.nulls(len(at), x) for x in (pa.int64(), pa.binary() if share is None else pa.list_(pa.int16()), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(n[at[:-1]], seen)), *none], names)

    kind = "binary" if share is None else "array<short>"
    both = table(docs.select("text").mapInArrow(lean(run), f"bucket long, n long, mark long, words {kind}, sizes binary"), "statistics")
    rows = both.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # 2**BITS + 1 rows
    n, seen = np.zeros(1 << BITS), 0
    for r in rows:
        if r["bucket"] < 0:
            seen = r["n"]
        else:
            n[r["bucket"]] = r["n"]
    passages = both.where("bucket is null")
    if sample is None:
        return n, seen, passages.select("words", "sizes")
    return n, seen, table(passages.select("mark", "words").orderBy("mark", "words").limit(sample), "passages")


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of values from each edge to the next."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All buckets and the passages' sizes."""
    if pa.types.is_list(b.column(0).type):
        return b.column(0).flatten().to_numpy(), np.diff(b.column(0).offsets.to_numpy())
    return W.raw(b.column(0))[0].view(np.int16), W.raw(b.column(1))[0].astype(np.int64)


def _units(col: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of TF-IDF rows of n buckets each, and the rows' norms."""
    key = np.sort(np.repeat(np.arange(len(n)), n) << BITS | col)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    row, col = key[at] >> BITS, key[at] & (1 << BITS) - 1
    v = np.diff(np.append(at, len(key))) * idf[col]
    return row, col, v, np.maximum(np.sqrt(np.bincount(row, v * v, len(n))), 1e-12)


def _weighted(words: list[list[int]], idf: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of unit TF-IDF rows."""
    n = np.array([len(x) for x in words], np.int64)
    row, col, v, norm = _units(np.fromiter((i for x in words for i in x), np.int64, int(n.sum())), n, idf)
    return row, col, weight * v / norm[row]


def _sums(x: np.ndarray, which: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sums of the next n[i] rows x[which], for each i; the rows of each at first step by step, for many i at once."""
    out, first = np.empty((len(n), x.shape[1]), np.float32), np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    for lo in range(0, len(n), 1024):
        at = order[lo : lo + 1024]
        size, begin = n[at], first[at]
        total = np.zeros((len(at), x.shape[1]), np.float32)
        one = np.empty_like(total)
        for step in range(min(96, int(size[0]))):
            k = int(np.searchsorted(-size, -step))  # those with more
            np.take(x, which[begin[:k] + step], axis=0, out=one[:k], mode="clip")
            total[:k] += one[:k]
        for i in range(int(np.searchsorted(-size, -96))):
            total[i] += x[which[begin[i] + 96 : begin[i] + size[i]]].sum(axis=0)
        out[at] = total
    return out


def _gram(col: np.ndarray, n: np.ndarray, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'(A q) for unit TF-IDF rows A of n buckets each, in strips of rows."""
    out, images = np.zeros(q.shape), (q * idf[:, None]).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(n)])
    for lo in range(0, len(n), STRIP):
        own = n[lo : lo + STRIP]
        c = col[first[lo] : first[lo + len(own)]].astype(np.int64)
        norm = _units(c, own, idf)[3]
        y = _sums(images, c, own) / (norm * norm)[:, None].astype(np.float32)
        order = np.argsort(c.astype(np.int16), kind="stable")  # by radix
        times = np.bincount(c, minlength=len(q))
        has = np.flatnonzero(times)
        out[has] += _sums(y, np.repeat(np.arange(len(own)), own)[order], times[has]) * idf[has, None]
    return out


def latent(passages: DataFrame, items: list[list[int]], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """A basis of the first right singular directions, 2**BITS by rank; it isn't turned to them, which no cosine within their space sees."""
    spark = passages.sparkSession
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((1 << BITS, rank)))[0]
    n = np.array([len(x) for x in items], np.int64)
    own = np.fromiter((i for x in items for i in x), np.int64, int(n.sum()))
    packed = "sizes" in passages.columns
    many = passages.agg(F.sum(F.octet_length("sizes")).alias("n")).first()["n"] if packed else passages.count()
    share = min(1.0, PASSAGES / max(1, many or 0))
    # a task returns 2**BITS by rank numbers, so it should have more passages than that
    passages = passages.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil((many or 0) / TASK)))
    strip = 64

    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((q.astype(np.float32), idf))  # 2**BITS by rank

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, idf = sent.value  # noqa: B023
            z, held, rows = np.zeros(q.shape), [], 0
            for b in batches:
                held.append(unpacked(b))
                rows += len(held[-1][1])
                if rows >= STRIP:
                    z += _gram(*map(np.concatenate, zip(*held, strict=True)), idf, q)
                    held, rows = [], 0
            if rows:
                z += _gram(*map(np.concatenate, zip(*held, strict=True)), idf, q)
            z = z.astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(range(0, 1 << BITS, strip), pa.int64()), pa.array([z[i : i + strip].tobytes() for i in range(0, 1 << BITS, strip)], pa.binary())], ["at", "part"])

        def add(t: pa.Table) -> pa.Table:
            z = sum(np.frombuffer(x.as_buffer(), np.float32).astype(float) for x in t["part"]).astype(np.float32)
            return pa.table({"at": t["at"].slice(0, 1), "part": pa.array([z.tobytes()], pa.binary())})

        got = passages.select("words", *["sizes"] * packed).mapInArrow(lean(product), "at long, part binary").groupBy("at").applyInArrow(add, "at long, part binary").collect()
        z = WEIGHT**2 * _gram(own, n, idf, q)
        for r in got:
            z[r["at"] : r["at"] + strip] += share * np.frombuffer(r["part"], np.float32).reshape(strip, rank)
        del got
        sent.destroy()
        release()
        q = np.linalg.qr(z)[0]
    return q


def masks(item: list[int]) -> dict[int, int]:
    """For each word of item, a bit for each place where it stands."""
    mask: dict[int, int] = {}
    for i, x in enumerate(item):
        mask[x] = mask.get(x, 0) | 1 << i
    return mask


def common(mask: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence of text and an item of `size` words."""
    v = full = (1 << size) - 1
    for x in text:
        if m := mask.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return size - v.bit_count()


def answered(item: list[int], text: list[int]) -> bool:
    """The item's last words come in order within three times their number of words."""
    tail, span = item[-ANSWER:], 3 * ANSWER
    for i, x in enumerate(text):
        if x == tail[0]:
            rest = iter(text[i + 1 : i + span])
            if all(y in rest for y in tail[1:]):
                return True
    return False


def cells(q: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, list[np.ndarray]]:
    """About sqrt(rows) centres of unit rows, as columns, and the rows of each."""
    k = max(1, math.isqrt(len(q)))
    c = q[np.random.default_rng(3).choice(len(q), k, replace=False)]
    for last in [*[False] * rounds, True]:
        own = np.concatenate([(q[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(q), 4096)])
        if last:
            return np.ascontiguousarray(c.T), [np.flatnonzero(own == j) for j in range(k)]
        total = np.zeros_like(c)
        np.add.at(total, own, q)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    raise AssertionError


class Search:
    """What a task needs: the latent image of each word, and the items with the parts that are searched for."""

    def __init__(self, items: list[tuple[int, list[int]]], direction: np.ndarray, idf: np.ndarray):
        self.items = items
        # one row more, of zeros, for where a block has no word
        self.images = np.vstack([direction * idf[:, None], np.zeros(direction.shape[1])]).astype(np.float32, order="C")  # rows are taken
        self.idf2 = np.append(idf * idf, 0).astype(np.float32)
        self.masks = [masks(words) for _, words in items]
        self.times = [dict(Counter(words)) for _, words in items]
        self.shapes = []
        for n, (blocks, longest) in enumerate(SHAPES):
            shortest = SHAPES[n - 1][1] if n else 0
            parts = [(i, words[a : a + longest]) for i, (_, words) in enumerate(items) for a in range(0, len(words), longest) if (len(words) <= longest or n == len(SHAPES) - 1) and (len(words) > shortest)]
            if parts:
                q = np.stack([self.images[_bucket(np.array(p, np.uint64))].sum(axis=0) for _, p in parts])
                q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
                self.shapes.append((blocks, np.array([i for i, _ in parts]), np.ascontiguousarray(q.T), *cells(q)))
        self._signs(idf)

    def _signs(self, idf: np.ndarray) -> None:
        """A sign of each item, some of its rarest places: their words with weights, and the weight that a leak has within a span."""
        post: list[tuple[int, int, int]] = []
        need, span = [], []
        for i, (_, words) in enumerate(self.items):
            lost = len(words) - math.ceil(PARAPHRASE * len(words) - 1e-9)  # a leak lacks so many at most
            rare = np.argsort(-idf[_bucket(np.array(words, np.uint64))], kind="stable")[: lost + max(3, lost // 3)].tolist()
            post += [(x, i, m) for x, m in Counter(words[a] for a in rare).items()]
            need.append(len(rare) - lost)
            span.append(max(REACH, 2 * len(words)))
        post.sort()
        word = np.array([x for x, _, _ in post], np.uint64)
        self.word, self.begin = np.unique(word, return_index=True)
        self.begin = np.append(self.begin, len(word))
        self.sign, self.weight = (np.array([x[c] for x in post], np.int64) for c in (1, 2))
        self.need, self.span = np.array(need), np.array(span)
        self.known = np.zeros(1 << BITS, bool)
        self.known[_bucket(self.word)] = True

    def sure(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, first word, last word + 1, item) of all places with a sign's weight, as columns."""
        at = np.flatnonzero(self.known[_bucket(h)])
        k = np.minimum(np.searchsorted(self.word, h[at]), len(self.word) - 1)
        same = self.word[k] == h[at]
        at, k = at[same], k[same]
        size = self.begin[k + 1] - self.begin[k]
        total, widest, lo = np.cumsum(size), int(self.span.max()), 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + POSTINGS)))
            back = int(np.searchsorted(at, at[lo] - widest))  # windows that end here begin there
            n = size[back:hi]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            post, p = np.repeat(self.begin[k[back:hi]], n) + nth, np.repeat(at[back:hi], n)
            key = self.sign[post] * len(h) + p
            order = np.argsort(key)
            key, p, post = key[order], p[order], post[order]
            s = self.sign[post]
            t = np.searchsorted(first, p, "right") - 1
            weight = np.concatenate([[0], np.cumsum(self.weight[post])])
            begin = np.searchsorted(key, s * len(h) + np.maximum(p - self.span[s] + 1, first[t]))
            good = (weight[1:] - weight[begin] >= self.need[s]) & (p >= at[lo])
            t, p, item = t[good], (p - first[t])[good], s[good]
            reach = self.span[item]
            yield t, np.maximum(p - reach, 0), np.minimum(p + reach, np.diff(first)[t]), item
            lo = hi

    def cosine(self, i: int, words: list[int]) -> float:
        """Of these words and the best part of item i."""
        b = _bucket(np.array(words, np.uint64))
        v = self.images[b].sum(axis=0) / np.sqrt(np.maximum(self.idf2[b].sum(), 1e-9))
        return max(float((v @ q[:, which == i]).max()) for _, which, q, _, _ in self.shapes if (which == i).any())

    def hits(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, first word, last word + 1, item, cosine) of the candidates in many texts' word hashes, as columns.

        Texts are laid out in blocks, each text in as many rows as the longest window has at least, the spare
        ones zero; strips of rows are summed, with the rows that windows reach into read again.
        """
        n = np.diff(first)
        blocks = -(-n // BLOCK)
        longest = SHAPES[-1][0]
        rows = np.where(blocks > 0, np.maximum(blocks, longest), 0)
        begin_row = np.cumsum(rows) - rows
        text = np.repeat(np.arange(len(n)), blocks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        row, word = begin_row[text] + nth, first[text] + nth * BLOCK
        end = np.minimum(word + BLOCK, first[text + 1])
        owner = np.repeat(np.arange(len(n)), rows)
        place = np.arange(len(owner)) - begin_row[owner]
        bucket, strip = _bucket(h), 1 << 12
        for lo in range(0, len(owner), strip):
            hi = min(lo + strip, len(owner))
            i, j = np.searchsorted(row, [lo, hi + longest - 1])
            if i == j:
                continue
            x = np.zeros((hi - lo + longest - 1, self.images.shape[1]), np.float32)
            m = np.zeros(len(x), np.float32)
            block = np.arange(BLOCK) + word[i:j, None]
            part = np.where(block < end[i:j, None], bucket[np.minimum(block, len(bucket) - 1)], 1 << BITS)
            total = self.images[part[:, 0]]
            one = np.empty_like(total)
            for b in range(1, BLOCK):
                total += np.take(self.images, part[:, b], axis=0, out=one, mode="clip")
            x[row[i:j] - lo] = total
            m[row[i:j] - lo] = self.idf2[part].sum(axis=1)
            for k, which, q, centre, own in self.shapes:
                v, mass = _sliding(x, k)[: hi - lo], _sliding(m, k)[: hi - lo]
                v = v / np.sqrt(np.maximum(mass, 1e-9))[:, None]
                fits = np.flatnonzero((place[lo:hi] <= np.maximum(blocks[owner[lo:hi]], k) - k) & (mass > 0))
                near = v[fits] @ centre
                few = min(PROBES, near.shape[1])
                probed = np.argpartition(-near, few - 1, axis=1)[:, :few].ravel() if len(fits) else np.zeros(0, int)
                order = np.argsort(probed, kind="stable")
                edge = np.searchsorted(probed[order], np.arange(len(own) + 1))
                for c, in_cell in enumerate(own):
                    rows = fits[order[edge[c] : edge[c + 1]] // few]
                    if not len(rows) or not len(in_cell):
                        continue
                    cos = v[rows] @ q[:, in_cell]
                    r, item = np.nonzero(cos >= COSINE)
                    t = owner[lo + rows[r]]
                    a = place[lo + rows[r]] * BLOCK
                    yield t, a, a + np.minimum(k, blocks[t]) * BLOCK, which[in_cell[item]], cos[r, item]

    def leaks(self, w: W.Words, h: np.ndarray) -> list[tuple[int, int, int, float, bool, float, int]]:
        """(text, item, common words, their share, answered, cosine, first word), the best place for each item that a text leaks."""
        out = self._told(w, h, self.hits(h, w.first), set())
        told = {(t, i) for i, (t, *_) in out}
        out += self._told(w, h, self.sure(h, w.first), told)
        return [best for _, best in sorted(out, key=lambda x: (x[1][0], x[0]))]

    def _told(self, w: W.Words, h: np.ndarray, found: Iterator[tuple[np.ndarray, ...]], told: set[tuple[int, int]]) -> list[tuple[int, tuple]]:
        """The leaks at the candidates, each after its item's place in items, but those that are told."""
        cols = list(found)
        if not cols:
            return []
        at, words, best = -1, [], {}
        for t, i, a, z, *cos in zip(*(c.tolist() for c in _places(*(np.concatenate(c) for c in zip(*cols, strict=True)))), strict=True):
            if (t, i) in told:
                continue
            if t != at:
                at, words = t, h[w.first[t] : w.first[t + 1]].tolist()
            ident, item = self.items[i]
            text = words[max(0, a - len(item)) : z + len(item)]
            # no more words can be common in order than the item has places of words that the text has
            if sum(map(self.times[i].get, self.times[i].keys() & set(text))) < PARAPHRASE * len(item):
                continue
            n = common(self.masks[i], len(item), text)
            share = n / len(item)
            said = share >= PARAPHRASE and answered(item, text)
            if (share >= EXACT or said) and ((t, i) not in best or n > best[t, i][2]):
                best[t, i] = (t, ident, n, share, said, cos[0] if cos else self.cosine(i, words[a:z]), a)
        return [(i, x) for (_, i), x in best.items()]


def _places(t: np.ndarray, a: np.ndarray, z: np.ndarray, item: np.ndarray, *cos: np.ndarray) -> list[np.ndarray]:
    """(text, item, first word, last word + 1, best cosine if there is one) in that order, overlapping windows of a text and item as one, of up to five windows' length."""
    order = np.lexsort((z, a, item, t))
    t, a, z, item, *cos = (c[order] for c in (t, a, z, item, *cos))
    gap = np.ones(len(t), bool)
    gap[1:] = (t[1:] != t[:-1]) | (item[1:] != item[:-1])
    level = np.cumsum(gap) * (int(z.max(initial=0)) + 1)
    reached = np.maximum.accumulate(z + level) - level  # by the windows of the same text and item so far
    gap[1:] |= a[1:] > reached[:-1]
    start = np.flatnonzero(gap)[np.cumsum(gap) - 1]
    piece = (a - a[start]) // (4 * np.maximum(z - a, 1)[start])
    gap[1:] |= piece[1:] != piece[:-1]
    at = np.flatnonzero(gap)
    return [t[at], item[at], a[at], *(np.maximum.reduceat(c, at) if len(at) else c for c in (z, *cos))]


def _sliding(x: np.ndarray, k: int) -> np.ndarray:
    """Sums of k rows from each row on, by doubling; k - 1 rows fewer than x."""
    out, have, double, size = None, 0, x, 1
    while True:
        if k & size:
            out = double if out is None else out[: len(double) - have] + double[have:]
            have += size
        if have == k:
            return out
        double, size = double[:-size] + double[size:], 2 * size


class Short:
    """Items of fewer than LEAST words, found word for word."""

    def __init__(self, items: list[tuple[int, list[int]]]):
        self.by: dict[int, dict[int, list[int]]] = {}
        for i, words in items:
            h = int(W.window_hash(np.array(words, np.uint64), len(words))[0])
            self.by.setdefault(len(words), {}).setdefault(h, []).append(i)

    def leaks(self, w: W.Words, h: np.ndarray) -> Iterator[tuple]:
        for k, known in self.by.items():
            run = W.window_hash(h, k)
            for at in np.flatnonzero(np.isin(run, np.array(list(known), np.uint64))).tolist():
                t = int(np.searchsorted(w.first, at, "right")) - 1
                a, z = w.first[t : t + 2].tolist()
                if at + k <= z and (k >= SHORT or (a, z) == (at, at + k)):
                    for i in known[int(run[at])]:
                        yield t, i, k, 1.0, True, 1.0, at - a


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, common_words, share, answered, cosine, first_word) of each document and item that it leaks."""
    spark = prepare(docs.sparkSession)
    docs = plain(docs, "doc_id", "text")
    known = plain(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    schema = "doc_id long, item_id long, common_words int, share double, answered boolean, cosine double, first_word long"
    size = known.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"]
    if not size:
        return spark.createDataFrame([], schema)
    blocks = math.ceil(size / ITEM_BYTES)
    df, n, passages = statistics(docs)
    idf = np.log((n + 1) / (df + 0.5)).clip(0.01)
    out = [_block(docs, known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else known, passages, idf, rank, schema) for k in range(blocks)]
    return functools.reduce(DataFrame.unionByName, [x for x in out if x is not None] or [spark.createDataFrame([], schema)])


def _block(docs: DataFrame, benchmark: DataFrame, passages: DataFrame, idf: np.ndarray, rank: int, schema: str) -> DataFrame | None:
    """The leaks of about ITEM_BYTES of items."""
    rows = benchmark.orderBy("item_id", "text").toArrow()
    w, h = tokens(rows["text"])
    every = [(i, h[a:z].tolist()) for i, a, z in zip(rows["item_id"].to_pylist(), w.first[:-1], w.first[1:], strict=True) if z > a]
    items, few = [x for x in every if len(x[1]) >= LEAST], [x for x in every if len(x[1]) < LEAST]
    if not every:
        return None
    buckets = [_bucket(np.array(x, np.uint64)).tolist() for _, x in items]
    search = Search(items, latent(passages, buckets, idf, rank), idf) if items else None
    sent = docs.sparkSession.sparkContext.broadcast((search, Short(few)))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.float64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, short = sent.value
        for b in batches:
            out = []
            for at, part in W.chunked(b.column(1)):
                w, h = tokens(part)
                told: dict[tuple[int, int], tuple] = {}
                for t, i, *x in [*short.leaks(w, h), *(search.leaks(w, h) if search else ())]:
                    told.setdefault((t, i), x)
                out += [(at + t, i, *x) for (t, i), x in told.items()]
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, k) for c, k in zip(cols[1:], kinds[1:], strict=True)]], names)

    return docs.mapInArrow(lean(run), schema)
