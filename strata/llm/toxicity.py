"""Toxicity scores from a counterfactually regularised classifier.

A logistic regression on the presence and density of hashed byte grams of the
lower-cased text. Besides the log loss it pays for labelled sentences that mention a
group: the sentence is written again with another term in its place, and the square
of the change of its logit is penalised. A term that merely goes along with
toxic examples then carries little weight, so neutral mentions aren't flagged.

Terms stand in for each other within a row of the lexicon IDENTITY. A corpus may hold none of these, or
others; so the labelled rows give neutral terms of their own, the TERMS most frequent words
that both labels have about alike (ODDS), and those with one ending stand in for each other. A sentence
with such a term also gives a pair of two lexicon terms in its place, so lexicon terms
that no labelled sentence has are made even as well. Model.pairs counts the pairs.

Fitting: all labelled rows outside the held-out quarter give, in a distributed count over their whole
texts, the FEATURES grams with the largest chi-square, and then their own sparse
features and those of SENTENCES sentences a text. Texts that surely have no label aren't shuffled to meet labels, and
counts of grams travel in compressed strips. Features of LOCAL rows at most come to the driver: LOCAL * (1 + 4 * SENTENCES) rows of
at most FEATURES small numbers, some 10 MB in practice. Those of more rows are written to the shared folder, and each
of the ROUNDS steps of the same descent sums its gradient over them in tasks, of which FEATURES numbers each come to the
driver. Scoring is a narrow pass over the whole texts of all documents.

Null and empty texts get the score of a text with no grams. A null doc_id is not
held out and has no label. Where rows of labels repeat a doc_id, toxic if any is; where documents do, the least text is learned.
Without labels of both kinds every score is the smoothed prior.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm import words as W
from strata.llm.runtime import lean, plain, prepare, release, table

LOCAL, FEATURES, BITS, SIZES, DENSITY = 20_000, 2048, 20, (4, 6, 7), (1500, 700, 350)
CHUNK = 250_000  # bytes of text at once; every byte begins a few grams of 8 bytes
SPACE_SIZE = (1 + len(DENSITY)) << BITS
TERMS, TERM_LETTERS, ODDS, SENTENCES = 256, 4, 0.7, 2
WORDS = 200_000  # that a task counts before it passes the counts on
STRIP = 4096  # features whose counts travel as one row
MARKS, MOST_MARKS = 16, 1 << 28  # bits for a row of labels, and at most
THRESHOLD, RIDGE, FAIR, ROUNDS, LEAST = 0.3, 1e-3, 1.0, 200, 6
PACKED = "kind int, y binary, sizes binary, f binary, s binary"
#: Terms of one row stand in for each other.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("disabled", "deaf", "blind", "elderly"),
    ("musulmans", "chrétiens", "juifs", "femmes", "hommes", "immigrés"),
    ("muslime", "christen", "juden", "frauen", "männer", "ausländer"),
    ("musulmanes", "cristianos", "judíos", "mujeres", "hombres", "inmigrantes"),
)


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, ASCII signs below the digits as spaces, a space around each text; bytes and offsets."""
    own = [f" {(x or '').lower()} ".encode() for x in texts.to_pylist()]
    b = np.frombuffer(b"".join(own), np.uint8).copy()
    b[b < 48] = 32
    return b, np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def _buckets(b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each gram size the bucket of every gram."""
    wide = b.astype(np.uint64)
    v, have = wide, 1
    for n in SIZES:
        while have < n:
            step = min(have, n - have)
            m = len(v) - step
            if m <= 0:
                return
            v = v[:m] | v[step:] >> np.uint64(8 * (have - step)) << np.uint64(8 * have)  # the last `step` bytes of the later one
            have += step
        h = v * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n * 0xC2B2AE3D27D4EB4F % 2**64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        yield n, (h >> np.uint64(64 - BITS)).astype(np.int32)


Lookup = tuple[np.ndarray, np.ndarray]  # of each feature its place in a model or -1, and of each bucket whether any of its features has one


def _present(texts: pa.Array, lookup: Lookup | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, by text. lookup: of a model; else all features as they are.

    Feature bucket + level * 2**BITS says that the bucket's grams come at least
    once (level 0), or at least once in DENSITY[level - 1] bytes of the text.
    """
    b, offs = _lowered(texts)
    column, wanted = lookup or (None, None)
    keys = [np.zeros(0, np.int64)]
    for n, bucket in _buckets(b):
        at = np.arange(len(bucket)) if wanted is None else np.flatnonzero(wanted[bucket])
        doc = np.searchsorted(offs, at, "right") - 1
        inside = at + n <= offs[doc + 1]
        keys.append(doc[inside].astype(np.int64) << BITS | bucket[at[inside]])
    k, times = np.unique(np.concatenate(keys), return_counts=True)
    doc, f = k >> BITS, k & (1 << BITS) - 1
    size = np.diff(offs)[doc]
    level = [(doc, f)]
    for i, d in enumerate(DENSITY, 1):
        dense = times * d >= size
        level.append((doc[dense], f[dense] + (i << BITS)))
    doc, f = (np.concatenate(c) for c in zip(*level, strict=True))
    if column is not None:
        f = column[f]
        doc, f = doc[f >= 0], f[f >= 0]
    order = np.argsort(doc, kind="stable")
    return doc[order], f[order].astype(np.int64)


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    pairs: int = 0  # swapped sentences that the penalty was over

    def lookup(self) -> Lookup:
        c = np.full(SPACE_SIZE, -1, np.int16)
        c[self.buckets] = np.arange(len(self.buckets))
        return c, (c.reshape(-1, 1 << BITS) >= 0).any(axis=0)

    def scores(self, texts: pa.Array, lookup: Lookup) -> np.ndarray:
        doc, f = _present(texts, lookup)
        return 1 / (1 + np.exp(-(np.bincount(doc, self.weights[f], len(texts)) + self.bias)))


def _swaps(text: str, terms: tuple[tuple[str, ...], ...], find, derived: tuple[tuple[str, ...], ...] = ()) -> list[tuple[str, str]]:
    """(sentence, sentence with its terms replaced), for the SENTENCES sentences of the smallest checksums that have a term, those of the lexicon first.

    Two for a sentence with lexicon terms; one for another's derived terms, and one of two lexicon terms in their place.
    """
    known, own = {t: row for row in terms for t in row}, {t: row for row in derived for t in row}
    out: list[tuple[str, str]] = []
    left = SENTENCES
    sentences = sorted((zlib.crc32(s.encode()), s) for s in set(regex.split(r"[.!?\n]+", text.lower())))
    found = [(n, s, set(find.findall(s))) for n, s in sentences]
    for n, s, has in sorted((x for x in found if x[2]), key=lambda x: (not x[2] & known.keys(), x[0])):
        if not left:
            break
        left -= 1
        group = known if has & known.keys() else own

        def other(step: int) -> str:
            return find.sub(lambda m: (r := group[m[0]])[(r.index(m[0]) + step) % len(r)] if m[0] in group else m[0], s)  # noqa: B023

        out.append((s, other(1)))
        if group is known:
            out.append((s, other(2)))
        elif terms:
            row = terms[n % len(terms)]
            a = row[n // len(terms) % len(row)]
            b = row[(row.index(a) + 1) % len(row)]
            out.append((find.sub(a, s, count=1), find.sub(b, s, count=1)))
    return out


def _derived(rows: DataFrame, positive: int, total: int) -> tuple[tuple[str, ...], ...]:
    """Neutral terms of labelled rows (text, toxic), in groups of one ending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = regex.compile(rf"\b\p{{L}}{{{TERM_LETTERS},24}}\b")
        n: tuple[Counter, Counter] = (Counter(), Counter())

        def counted() -> pa.RecordBatch:
            every = sorted(n[0].keys() | n[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([n[0][w] for w in every], pa.int64()), pa.array([n[1][w] for w in every], pa.int64())], ["word", "n0", "n1"])
            for c in n:
                c.clear()
            return out

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[y > 0].update(set(word.findall((x or "").lower())))
                if len(n[0]) + len(n[1]) >= WORDS:
                    yield counted()
        yield counted()

    n = rows.mapInArrow(lean(run), "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (positive + 1) / ((F.col("n0") + 0.5) / (total - positive + 1)))
    few = n.where((F.col("n0") >= LEAST) & (F.col("n1") >= 2) & (F.abs(odds) <= ODDS)).orderBy((F.col("n0") + F.col("n1")).desc(), "word").limit(TERMS)
    by: dict[str, list[str]] = defaultdict(list)
    for r in few.collect():  # TERMS rows at most
        by[r["word"][-2:]].append(r["word"])
    return tuple(tuple(x) for x in by.values() if len(x) > 1)


def _squeezed(n: np.ndarray) -> bytes:
    """Counts of 4 bytes, lowest bytes first: most are small, so that the others are zeros."""
    return pa.compress(np.ascontiguousarray(n, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _spread(b: bytes) -> np.ndarray:
    """The counts of a strip by label that _squeezed made small."""
    planes = np.frombuffer(pa.decompress(b, 8 * STRIP, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").reshape(2, STRIP)


def _totals(rows: DataFrame) -> DataFrame:
    """Of each feature that LEAST texts have, in how many of the rows (text, toxic) of either label it comes: bucket, n0, n1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, SPACE_SIZE), np.int32)
        for b in batches:
            y = b.column(1).to_numpy()
            for i, part in W.chunked(b.column(0), CHUNK):
                doc, f = _present(part)
                hit = y[i : i + len(part)][doc] > 0
                np.add.at(n[0], f[~hit], 1)
                np.add.at(n[1], f[hit], 1)
        at = np.flatnonzero(n.any(axis=0).reshape(-1, STRIP).any(axis=1))
        for i in range(0, len(at), 256):
            held = [_squeezed(n[:, k * STRIP : (k + 1) * STRIP]) for k in at[i : i + 256]]
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 256]), pa.array(held, pa.binary())], ["strip", "n"])

    def add(t: pa.Table) -> pa.Table:
        n = np.zeros((2, STRIP), np.int64)
        for x in t["n"]:
            n += _spread(x.as_buffer())
        at = np.flatnonzero(n.sum(axis=0) >= LEAST)
        return pa.table({"bucket": pa.array(at + t["strip"][0].as_py() * STRIP, pa.int64()), "n0": n[0, at], "n1": n[1, at]})

    return rows.mapInArrow(lean(count), "strip long, n binary").groupBy("strip").applyInArrow(add, "bucket long, n0 long, n1 long")


def _strips(edges: np.ndarray, most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have about `most` entries."""
    lo = 0
    while lo < len(edges) - 1:
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def _products(edges: np.ndarray, feature: np.ndarray, w: np.ndarray, width: int, outer, sign: np.ndarray | None = None) -> np.ndarray:
    """X' outer(X w), for a sparse X with rows at edges, in strips; outer gets the first row and the strip's X w."""
    out = np.zeros(width)
    for lo, hi in _strips(edges):
        a, z = edges[lo], edges[hi]
        f, row = feature[a:z].astype(np.int64), np.repeat(np.arange(hi - lo), np.diff(edges[lo : hi + 1]))
        s = 1.0 if sign is None else sign[a:z]
        out += np.bincount(f, outer(lo, np.bincount(row, w[f] * s, hi - lo))[row] * s, width)
    return out


def _pull(edges: np.ndarray, feature: np.ndarray, y: np.ndarray, w: np.ndarray, bias: float, n: int) -> tuple[np.ndarray, float]:
    """The gradient by weights and bias of the log loss of these rows, of n rows in all."""
    gb = 0.0

    def error(lo: int, x: np.ndarray) -> np.ndarray:
        nonlocal gb
        g = (1 / (1 + np.exp(-(x + bias))) - y[lo : lo + len(x)]) / n
        gb += g.sum()
        return g

    return _products(edges, feature, w, len(w), error), gb


def _even(edges: np.ndarray, feature: np.ndarray, sign: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The gradient of the sum over pairs of (w . difference)^2 / 2."""
    return _products(edges, feature, w, len(w), lambda _, x: x, sign)


def _descend(width: int, n: int, toxic: float, pairs: int, fair: float, gradient: Callable[[np.ndarray, float], tuple[np.ndarray, float, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on: log loss + RIDGE |w|^2 / 2 + fair * mean over pairs of (w . difference)^2 / 2. gradient gives _pull and _even over all n rows and pairs."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    prior = float(np.log((toxic + 0.5) / (n - toxic + 0.5)))
    bias, mb, vb = prior, 0.0, 0.0
    if not n or not 0 < toxic < n:
        return w, prior
    for t in range(1, ROUNDS + 1):
        gw, gb, even = gradient(w, bias)
        gw = gw + RIDGE * w
        if pairs and fair:
            gw += fair / pairs * even
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, float(bias)


def fit_features(edges: np.ndarray, feature: np.ndarray, y: np.ndarray, width: int, pair_edges: np.ndarray | None = None, pair_feature: np.ndarray | None = None, sign: np.ndarray | None = None, fair: float = FAIR) -> tuple[np.ndarray, float]:
    """_descend in one process.

    Row i has the features feature[edges[i]:edges[i + 1]]; pairs alike, with the sign of each.
    """
    pairs = 0 if pair_edges is None else len(pair_edges) - 1

    def gradient(w: np.ndarray, bias: float) -> tuple[np.ndarray, float, np.ndarray]:
        return *_pull(edges, feature, y, w, bias, len(y)), _even(pair_edges, pair_feature, sign, w) if pairs and fair else np.zeros(width)

    return _descend(width, len(edges) - 1, y.sum(), pairs, fair, gradient)


def fit_packed(rows: DataFrame, width: int, n: int, toxic: int, pairs: int, fair: float) -> tuple[np.ndarray, float]:
    """_descend over rows as _rows has them, of which tasks return sums only."""

    def gradient(w: np.ndarray, bias: float) -> tuple[np.ndarray, float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * width + 1)
            for b in batches:
                kinds = b.column(0).to_numpy()
                for kind in np.unique(kinds):
                    y, edges, f, s = unpacked(b.filter(pa.array(kinds == kind)))
                    if kind == 0:
                        gw, gb = _pull(edges, f, y, w, bias, n)
                        total[:width] += gw
                        total[-1] += gb
                    elif fair:
                        total[width:-1] += _even(edges, f, s, w)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        # not by lean: so little is held that giving memory back in each round would cost more
        got = rows.mapInArrow(run, "part binary").collect()  # 2 * FEATURES + 1 numbers a task
        total = sum((np.frombuffer(r["part"]) for r in got), np.zeros(2 * width + 1))
        return total[:width], float(total[-1]), total[width:-1]

    return _descend(width, n, toxic, pairs, fair, gradient)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _likely(text: DataFrame, own: DataFrame) -> DataFrame:
    """Rows of text whose doc_id own may have: all that it has, and few others.

    own's doc_ids are bits of a broadcast bitmap, so that a join with own needn't shuffle texts that it drops. Beyond
    MOST_MARKS bits the bitmap grows no more and more rows get through.
    """
    if text.schema["doc_id"].dataType != own.schema["doc_id"].dataType:
        return text  # the join casts, and a hash goes by type
    bits = min(max(own.count(), 1) * MARKS, MOST_MARKS)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    run, bit = F.shiftright(place, 15), place % (1 << 15)  # bitmap_construct_agg makes 2**15 bits
    marks = own.groupBy(run.alias("_run")).agg(F.bitmap_construct_agg(bit).alias("_marks"))
    byte = F.conv(F.hex(F.substring("_marks", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return text.join(F.broadcast(marks), (run == F.col("_run")) & (F.getbit(byte, bit % 8) == 1), "left_semi")


def fit(docs: DataFrame, labels: DataFrame, sample: int | None = None, fair: float = FAIR, terms: tuple[tuple[str, ...], ...] = IDENTITY) -> Model:
    """A model from all labelled documents outside the held-out quarter, or at most `sample` of them. terms: the lexicon, in rows of at least two."""
    spark = prepare(docs.sparkSession)
    own = plain(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out())
    text = _likely(plain(docs, "doc_id", "text").where(~held_out()), own)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if sample is not None:
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = text.join(own, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = table(rows.select("text", "toxic"), "labelled")

    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("toxic") > 0, 1)), F.lit(0)).alias("n1")).first()
    if not size["n1"] or size["n1"] == size["n"]:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((size["n1"] + 0.5) / (size["n"] - size["n1"] + 0.5))))
    q = size["n1"] / size["n"]
    m = F.col("n0") + F.col("n1")
    chi = F.pow(F.col("n1") - m * q, F.lit(2)) / (m * q * (1 - q) * (1 - m / F.lit(float(size["n"]) + 1)))
    best = _totals(rows).orderBy(chi.desc(), "bucket").limit(FEATURES).select("bucket").collect()
    model = Model(np.array([r["bucket"] for r in best], np.int64), np.zeros(len(best)), 0.0)
    derived = _derived(rows, size["n1"], size["n"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = model.lookup()
        find = regex.compile(r"\b\L<t>\b", t=[t for row in (*terms, *derived) for t in row])
        for b in batches:
            y = b.column(1).to_numpy() > 0
            for i, part in W.chunked(b.column(0), CHUNK):
                doc, f = _present(part, lookup)
                edges = np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)
                yield _rows(0, y[i : i + len(part)], edges, f, np.ones(len(f)))
                swaps = [s for x in part.to_pylist() if x for s in _swaps(x, terms, find, derived)]
                if swaps:
                    a, fa = _present(pa.array([s for s, _ in swaps]), lookup)
                    z, fz = _present(pa.array([s for _, s in swaps]), lookup)
                    which, f, sign = np.concatenate([a, z]), np.concatenate([fa, fz]), np.repeat([1.0, -1.0], [len(a), len(z)])
                    o = np.argsort(which, kind="stable")
                    edges = np.searchsorted(which[o], np.arange(len(swaps) + 1)).astype(np.int32)
                    yield _rows(1, np.zeros(len(swaps), np.int64), edges, f[o], sign[o])

    packed = rows.mapInArrow(lean(features), PACKED)
    if size["n"] > LOCAL:
        packed = table(packed, "features")
        model.pairs = packed.where("kind = 1").agg(F.coalesce(F.sum(F.octet_length("sizes")), F.lit(0)).alias("b")).first()["b"] // 4
        model.weights, model.bias = fit_packed(packed, len(best), size["n"], size["n1"], model.pairs, fair)
        return model
    got = packed.toArrow()
    (y, edges, f, _), (_, pair_edges, pair_feature, sign) = (unpacked(got.filter(pc.equal(got["kind"], kind))) for kind in (0, 1))
    model.pairs = len(pair_edges) - 1
    model.weights, model.bias = fit_features(edges, f, y, len(best), pair_edges, pair_feature, sign, fair)
    del got, f, pair_feature, sign
    release()
    return model


def _rows(kind: int, y: np.ndarray, edges: np.ndarray, f: np.ndarray, sign: np.ndarray) -> pa.RecordBatch:
    """Many rows' labels and sizes, and their features with signs, as one row of bytes."""
    held = (y.astype(np.int8), np.diff(edges).astype(np.int32), f.astype(np.int16), sign.astype(np.int8))
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in held]], ["kind", "y", "sizes", "f", "s"])


def unpacked(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, edges, features and signs of rows that _rows made."""
    y, size, f, s = (np.frombuffer(b"".join(b.column(i).to_pylist()), t) for i, t in enumerate((np.int8, np.int32, np.int16, np.int8), 1))
    return y.astype(float), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), f, s


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row and column of docs, and score."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # FEATURES numbers
    docs = docs.drop("score")
    at, names = docs.columns.index("text"), [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        lookup = m.lookup()
        for b in batches:
            s = [m.scores(part, lookup) for _, part in W.chunked(b.column(at), CHUNK)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(s) if s else np.zeros(0))], names)

    from pyspark.sql import types as T

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields]).add("score", "double"))
