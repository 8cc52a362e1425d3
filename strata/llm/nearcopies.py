"""Near copies by similarity, on top of the fuzzy links of :mod:`strata.llm.simhash`.

For filtering a corpus: two texts are near copies if the Jaccard similarity of
their sets of SHINGLE-word shingles is at least SIMILARITY. Equal texts are one
class by digest. A class has a SimHash of its distinct words for each of VIEWS
hashes, and Golay-code keys of all of them bring candidates together. That isn't
exact: some pairs just above SIMILARITY are within 3 bits in none of the views.
Candidates are compared by bottom-k sketches, which only drop pairs far below
the mark, and the rest by their whole shingle sets.

The texts of a key's run are grouped by their close pairs, so that texts which a key holds by
chance, more of them the larger the corpus is, change nothing. A group of up to RUN texts gives all its
close pairs. A larger one is a crowd,
and its texts are open: each is only paired with the HUB, the text with the most close
ones, which in a crowd of edited copies is likely the copies' origin. The
first view is searched before the others, where texts that are open already aren't
paired with each other. Of more than PAIRS smaller candidates a text is held against
those met in most runs, and is open with all of them.

What that leaves out is found exactly then. Open texts, linked or not, are first held
against the hubs of their MINIMA smallest shingle hashes: of the texts that share one,
that with the most common shingles. Then they are joined on the shingles of their prefixes, the rarest fifth of their shingles and one more, as
any two sets of that similarity share one of these; only pairs of two groups are
compared. So a crowd loses no link.

Texts without words have no near copies. A row whose doc_id is null is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import simhash
from strata.llm import words as W
from strata.llm.components import components
from strata.llm.runtime import lean, parts, plain, prepare, table

SHINGLE, SIMILARITY, VIEWS, SKETCH, RUN, PAIRS = 5, 0.8, 12, 64, 16, 12
MINIMA, COUNTERS = 4, 18  # bits of a shingle's hash that name its counter
SHORT, WIDE = 64, 1 << 14
HELD = 200_000  # rows or pairs that a task has at once
_MARGIN = 0.25  # over 4 standard errors of a sketch


def _shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = W.of(texts, fold=True)
    a, b, doc = W.shingles(w, SHINGLE)
    h = W.span_hash(w.buf, w.start[a], w.end[b])
    cut = np.searchsorted(doc, np.arange(1, len(texts)))
    return [np.unique(x) for x in np.split(h, cut)] if len(texts) else []


def _all_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sets of texts of any size, some at a time."""
    return [x for _, part in W.chunked(texts) for x in _shingle_sets(part)]


def _prints(docs: DataFrame, views: int) -> DataFrame:
    """A row for each document: digest, fingerprints of its distinct words, bottom-k sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, part in W.chunked(b.column(1)):
                w = W.of(part, fold=True)
                doc, own = w.doc(), W.span_hash(w.buf, w.start, w.end)
                order = np.lexsort((own, doc))
                new = np.ones(len(own), bool)
                new[1:] = (own[order][1:] != own[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                at = order[new]
                n = np.bincount(doc[at], minlength=len(part))
                fp = np.stack([simhash.majority(W.mix(own[at] ^ W.mix(np.array([v], np.uint64) + W.P3)), n) for v in range(views)], axis=1).view(np.int64)
                sketch = [x[:SKETCH].view(np.int64).tolist() for x in _shingle_sets(part)]
                sums = [hashlib.sha1((x or "").encode()).digest() for x in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), pa.array(sums, pa.binary()), pa.array(fp.tolist(), pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "digest", "fps", "sketch"])

    return docs.mapInArrow(lean(run), "doc_id long, digest binary, fps array<long>, sketch array<long>")


def _pairs(fp: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs within each of the runs that lie one after another, as positions; all runs a step at a time."""
    left = np.repeat(np.cumsum(size), size) - np.arange(len(fp))
    i, j, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
    at = np.flatnonzero(left > 1)
    while len(at):
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= simhash.MAX_BITS]
        i.append(near)
        j.append(near + step)
        step += 1
        at = at[left[at] > step]
    return np.concatenate(i), np.concatenate(j)


def _sparse(fp: np.ndarray, is_open: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Close pairs of one long run but those of two open texts, of which many are taken as linked; None where there are too many."""
    own = np.flatnonzero(~is_open)
    i, j, have, most = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 2 * RUN * len(fp)
    for lo in range(0, len(own), strip := max(1, HELD * 8 // len(fp))):
        k = own[lo : lo + strip]
        r, c = np.nonzero(np.bitwise_count(fp[k][:, None] ^ fp) <= simhash.MAX_BITS)
        once = (k[r] < c) | is_open[c]
        i.append(k[r[once]])
        j.append(c[once])
        have += len(i[-1])
        if have > most:
            return None
    known = np.flatnonzero(is_open)
    if len(known) > RUN:
        i.append(known[:-1])
        j.append(known[1:])
    return np.concatenate(i), np.concatenate(j)


def _grouped(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n positions the smallest that the links (i, j) reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        if (root[i] == low).all() and (root[j] == low).all():
            return root
        for k in (i, j):
            np.minimum.at(root, root[k], low)
            np.minimum.at(root, k, low)
        root = root[root]


def _told(fp: np.ndarray, ident: np.ndarray, is_open: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """(a, b, crowded) of the links (i, j): the pairs of small groups; in a crowd a pair with its hub, or with itself, for each text that isn't open."""
    root = _grouped(len(fp), i, j)
    crowd = np.bincount(root, minlength=len(fp))[root] > RUN
    good = ~crowd[i] & ~(is_open[i] & is_open[j])
    out = np.stack([ident[i[good]], ident[j[good]], np.zeros(good.sum(), np.int64)])
    own = np.flatnonzero(crowd & ~is_open)
    if not len(own):
        return out
    links = np.bincount(i, minlength=len(fp)) + np.bincount(j, minlength=len(fp))
    every = np.flatnonzero(crowd)
    every = every[np.lexsort((-links[every], root[every]))]
    hub = every[np.searchsorted(root[every], root[own])]
    return np.hstack([out, _to_hub(fp, ident, own, hub)])


def _to_hub(fp: np.ndarray, ident: np.ndarray, own: np.ndarray, hub: np.ndarray | np.int64) -> np.ndarray:
    to = np.where(np.bitwise_count(fp[own] ^ fp[hub]) <= simhash.MAX_BITS, hub, own)
    return np.stack([ident[to], ident[own], np.ones(len(own), np.int64)])


def _long(fp: np.ndarray, ident: np.ndarray, is_open: np.ndarray) -> np.ndarray:
    """_told of one run of over SHORT texts."""
    if len(fp) <= WIDE and (some := _sparse(fp, is_open)):
        return _told(fp, ident, is_open, *some)
    own = np.flatnonzero(~is_open)
    if len(fp) <= WIDE:  # in a larger one all are taken to be close to some
        own = own[[(np.bitwise_count(fp ^ fp[i]) <= simhash.MAX_BITS).sum() > 1 for i in own]]
    return _to_hub(fp, ident, own, np.bitwise_count(fp ^ simhash.majority(fp, np.array([len(fp)]))).argmin())


def _met(got: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (a, b, crowded, runs) of a <= b, each once: runs is how often the pair was met."""
    a = np.concatenate(got, axis=1) if got else np.zeros((3, 0), np.int64)
    low, high, crowded = np.minimum(a[0], a[1]), np.maximum(a[0], a[1]), a[2] > 0
    order = np.lexsort((low, high))
    low, high, crowded = low[order], high[order], crowded[order]
    at = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(low) else np.zeros(0, int)
    some = np.logical_or.reduceat(crowded, at) if len(at) else crowded
    return pa.RecordBatch.from_arrays([pa.array(low[at]), pa.array(high[at]), pa.array(some), pa.array(np.diff(np.append(at, len(low))))], ["a", "b", "crowded", "runs"])


def _meet(key: np.ndarray, fp: np.ndarray, ident: np.ndarray, is_open: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The close pairs in whole runs of keys, sorted by key and id."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])
    key, fp, ident, is_open = key[new], fp[new].view(np.uint64), ident[new], is_open[new]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    size = np.diff(np.append(begin, len(key)))
    live = (size > 1) & ~np.logical_and.reduceat(is_open, begin) if len(key) else np.zeros(0, bool)
    got, have = [], 0
    runs = np.flatnonzero(live & (size <= SHORT))
    some = np.flatnonzero(np.repeat(live & (size <= SHORT), size))
    edge = np.concatenate([[0], np.cumsum(size[runs])])
    cuts = np.unique(np.append(np.searchsorted(edge, np.arange(0, len(some), HELD // 4)), len(runs)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = some[edge[lo] : edge[hi]]
        got.append(_told(fp[at], ident[at], is_open[at], *_pairs(fp[at], size[runs[lo:hi]])))
        have += got[-1].shape[1]
        if have >= HELD:
            yield _met(got)
            got, have = [], 0
    for r in np.flatnonzero(live & (size > SHORT)):
        at = slice(begin[r], begin[r] + size[r])
        got.append(_long(fp[at], ident[at], is_open[at]))
        have += got[-1].shape[1]
        if have >= HELD:
            yield _met(got)
            got, have = [], 0
    yield _met(got)


def _whole_runs(flush):
    """flush(columns) over whole runs of the first column, some HELD rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            key = b.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if size + len(key) >= HELD and (cut or held and held[-1][0][-1] != key[0]):  # the last key may go on
                yield from flush(*[np.concatenate(c) for c in zip(*held, [c[:cut] for c in columns], strict=True)])
                held, size = [], 0
                columns = [c[cut:] for c in columns]
            if len(columns[0]):
                held.append(columns)
                size += len(columns[0])
        if held:
            yield from flush(*[np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, crowded, runs) sorted by b and a, each once, with tried: to be compared, and many: b has over PAIRS smaller candidates.

    A text's pair with itself only says that it is open.
    """

    def rows(b: np.ndarray, a: np.ndarray, crowded: np.ndarray, tried: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, crowded, tried, many)], ["a", "b", "crowded", "tried", "many"])

    def whole(b: np.ndarray, a: np.ndarray, crowded: np.ndarray, runs: np.ndarray, more: bool) -> pa.RecordBatch:
        order = np.lexsort((a, -runs, a == b, b))
        b, a, crowded = b[order], a[order], crowded[order]
        begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        size = np.diff(np.append(begin, len(b)))
        many = np.add.reduceat(a != b, begin) > PAIRS
        many[0] |= more
        return rows(b, a, crowded, (np.arange(len(b)) - np.repeat(begin, size) < PAIRS) & (a != b), np.repeat(many, size))

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]  # of the last b
    more = False  # some of its pairs went before
    for x in batches:
        b, a, crowded, runs = (np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, (x.column(1), x.column(0), x.column(2), x.column(3)), strict=True))
        if not len(b):
            continue
        order = np.lexsort((a, b))
        b, a, crowded, runs = b[order], a[order], crowded[order], runs[order]
        at = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (a[1:] != a[:-1])]))
        b, a, crowded, runs = b[at], a[at], np.logical_or.reduceat(crowded, at), np.add.reduceat(runs, at)
        cut = int(np.searchsorted(b, b[-1]))
        if cut:
            yield whole(b[:cut], a[:cut], crowded[:cut], runs[:cut], more)
            more = False
        b, a, crowded, runs = b[cut:], a[cut:], crowded[cut:], runs[cut:]
        if len(b) > 4 * PAIRS:  # of any number only the best are kept
            order = np.lexsort((a, -runs, a == b))
            rest, best = order[2 * PAIRS :], order[: 2 * PAIRS]
            yield rows(b[rest], a[rest], crowded[rest], np.zeros(len(rest), bool), np.ones(len(rest), bool))
            b, a, crowded, runs = b[best], a[best], crowded[best], runs[best]
            more = True
        held = [b, a, crowded, runs]
    if len(held[0]):
        yield whole(*held, more)


def _candidates(texts: DataFrame) -> DataFrame:
    """(a, b, crowded, tried, many): close pairs of texts (id, fps, open), a <= b; crowded: of a run that didn't give all of its pairs."""
    n = parts(texts.sparkSession)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ident = b.column(0).to_numpy()
            fps = np.array(b.column(1).to_pylist(), np.int64).reshape(len(ident), -1)
            for v in range(fps.shape[1]):
                fp = fps[:, v].copy()
                r, k = simhash.golay_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(k | v << 26), pa.array(fp[r]), pa.array(ident[r]), b.column(2).take(pa.array(r))], ["key", "fp", "id", "open"])

    keys = texts.select("id", "fps", "open").mapInArrow(lean(file, "golay"), "key long, fp long, id long, open boolean")
    met = keys.repartition(n, "key").sortWithinPartitions("key", "id").mapInArrow(lean(_whole_runs(_meet)), "a long, b long, crowded boolean, runs long")
    return met.repartition(n, "b").sortWithinPartitions("b", "a").mapInArrow(lean(_pick), "a long, b long, crowded boolean, tried boolean, many boolean")


def _open(met: DataFrame) -> DataFrame:
    some = met.where("crowded or many")
    return some.select(F.col("a").alias("id")).distinct().union(some.select("b").distinct()).distinct()


def _apart(similarity: float):
    """Pairs of two roots in runs of one shingle that may be similar; a < b.

    Where the run's shingle is the first that two sets share, no more than what follows in both can be common. So
    pairs with too little left are dropped: the run of their first one has them, if any has.
    """

    def flush(shingle: np.ndarray, ident: np.ndarray, root: np.ndarray, size: np.ndarray, left: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        mixed = np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin)
        got, have = [np.zeros((2, 0), np.int64)], 0
        for at, end in zip(begin[mixed], np.append(begin[1:], len(shingle))[mixed], strict=True):
            own, r, n, more = ident[at:end], root[at:end], size[at:end], left[at:end]
            _, of, times = np.unique(r, return_inverse=True, return_counts=True)
            most = of == times.argmax()  # pairs of the largest group's own are not looked at
            later = np.arange(len(own))
            for i in np.flatnonzero(~most):
                j = np.flatnonzero((r != r[i]) & (most | (later > i)) & (np.minimum(more, more[i]) * (1 + similarity) >= similarity * (n + n[i]) - 1e-6))
                got.append(np.sort(np.stack([np.full(len(j), own[i]), own[j]]), axis=0))
                have += len(j)
                if have >= HELD:
                    yield _once(got)
                    got, have = [], 0
        yield _once(got)

    return flush


def _once(got: list[np.ndarray]) -> pa.RecordBatch:
    a = np.unique(np.concatenate(got, axis=1), axis=1) if got else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in a], ["a", "b"])


def _hubs(similarity: float):
    """Pairs with the text of the best score, in runs of one key, where roots differ and sizes allow the similarity."""

    def flush(key: np.ndarray, ident: np.ndarray, root: np.ndarray, size: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((ident, -score, key))
        key, ident, root, size = key[order], ident[order], root[order], size[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        hub = np.flatnonzero(new)[np.cumsum(new) - 1]
        good = (root != root[hub]) & (np.minimum(size, size[hub]) >= similarity * np.maximum(size, size[hub]))
        yield _once([np.sort(np.stack([ident[good], ident[hub[good]]]), axis=0)])

    return flush


def _counters(texts: DataFrame) -> np.ndarray:
    """How many texts have a shingle, for each of 2**COUNTERS groups of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COUNTERS, np.int64)
        for b in batches:
            for _, part in W.chunked(b.column(0)):
                n += np.bincount(np.concatenate([_counter(x) for x in _shingle_sets(part)]), minlength=len(n))
        strips = n.reshape(-1, 4096)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(strips))), pa.array([x.tobytes() for x in strips], pa.binary())], ["strip", "n"])

    def add(t: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x.as_buffer(), np.int64) for x in t["n"])
        return pa.table({"strip": t["strip"].slice(0, 1), "n": pa.array([n.tobytes()], pa.binary())})

    rows = texts.select("text").mapInArrow(lean(run), "strip long, n binary").groupBy("strip").applyInArrow(add, "strip long, n binary").collect()  # 2**COUNTERS numbers
    count = np.zeros((1 << COUNTERS) // 4096 * 4096, np.int64).reshape(-1, 4096)
    for r in rows:
        count[r["strip"]] = np.frombuffer(r["n"], np.int64)
    return count.reshape(-1)


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _linking(texts: DataFrame, count, similarity: float) -> DataFrame:
    """(a, b): of texts (id, root, text), pairs of two roots with hubs, MINIMA for each text at most; count: a broadcast of _counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.log2(count.value + 1.0)
        salts = W.mix(np.arange(1, MINIMA + 1, dtype=np.uint64))
        for b in batches:
            for i, part in W.chunked(b.column(2)):
                sets = _shingle_sets(part)
                keys = np.array([[W.mix(x ^ s).min() ^ s for s in salts] for x in sets], np.uint64).reshape(-1)
                of = np.repeat(np.arange(len(sets)), MINIMA)
                size, score = np.array([len(x) for x in sets]), np.array([often[_counter(x)].mean() for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(0).take(pa.array(of + i)), b.column(1).take(pa.array(of + i)), pa.array(size[of]), pa.array(score[of])], ["key", "id", "root", "size", "score"])

    rows = texts.select("id", "root", "text").mapInArrow(lean(run), "key long, id long, root long, size long, score double")
    runs = rows.repartition(parts(texts.sparkSession), "key").sortWithinPartitions("key")
    return runs.mapInArrow(lean(_whole_runs(_hubs(similarity))), "a long, b long").distinct()


def _rest(texts: DataFrame, count, similarity: float) -> DataFrame:
    """(a, b): of texts (id, root, text), every pair of two roots that may be similar, by prefix filtering; a < b."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = count.value
        for b in batches:
            for i, part in W.chunked(b.column(2)):
                sets = _shingle_sets(part)
                size = np.array([len(x) for x in sets])
                # any fixed order of all shingles is right; the rarest first give the fewest pairs
                own = [x[np.lexsort((x, often[_counter(x)]))[: len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1]] for x in sets]
                per = np.array([len(x) for x in own])
                of = np.repeat(np.arange(len(sets)), per)
                left = size[of] - (np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), b.column(0).take(pa.array(of + i)), b.column(1).take(pa.array(of + i)), pa.array(size[of]), pa.array(left)], ["shingle", "id", "root", "size", "left"])

    prefix = texts.select("id", "root", "text").mapInArrow(lean(prefixes), "shingle long, id long, root long, size long, left long")
    runs = prefix.repartition(parts(texts.sparkSession), "shingle").sortWithinPartitions("shingle", "id")
    return runs.mapInArrow(lean(_whole_runs(_apart(similarity))), "a long, b long").distinct()


def _verify(pairs: DataFrame, texts: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets are similar enough; texts: (id, sketch), bodies: (id, text)."""
    side = lambda t, col, end: t.select(F.col("id").alias(end), F.col(col).alias(f"{end}_{col}"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.array(v.as_py(), np.int64).view(np.uint64) for v in (x, y))
                union = np.union1d(p, q)[:SKETCH]
                both = np.isin(union, p, assume_unique=True) & np.isin(union, q, assume_unique=True)
                keep.append(bool(len(union)) and both.mean() >= similarity - _MARGIN)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, part in W.chunked(b.column(2)):
                for p, q in zip(_all_sets(part), _all_sets(b.column(3).slice(i, len(part))), strict=True):
                    n = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(n > 0 and n >= similarity * (len(p) + len(q) - n))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    some = pairs.join(side(texts, "sketch", "a"), "a").join(side(texts, "sketch", "b"), "b").select("a", "b", "a_sketch", "b_sketch")
    some = table(some.mapInArrow(lean(likely), "a long, b long"), "likely")
    full = some.join(side(bodies, "text", "a"), "a").join(side(bodies, "text", "b"), "b").select("a", "b", "a_text", "b_text")
    return table(full.mapInArrow(lean(exact), "a long, b long"), "copies")


def groups(docs: DataFrame, similarity: float = SIMILARITY, views: int = VIEWS) -> DataFrame:
    """(doc_id, group): for each doc_id with an equal or near copy of another's text, the smallest doc_id of its group."""
    prepare(docs.sparkSession)
    own = plain(docs, "doc_id", "text").where("doc_id is not null")
    prints = table(_prints(own, views), "prints")
    classes = prints.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("fps").alias("fps"), F.first("sketch").alias("sketch"))
    classes = table(classes, "classes")
    equal = prints.select("doc_id", "digest").join(classes.select("digest", "id"), "digest").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    alive = classes.where(F.size("sketch") > 0)
    first = table(_candidates(alive.select("id", F.slice("fps", 1, 1).alias("fps"), F.lit(False).alias("open"))), "met")
    crowds = table(_open(first), "crowds")
    others = alive.select("id", F.slice("fps", 2, views).alias("fps")).join(crowds.withColumn("open", F.lit(True)), "id", "left")
    second = table(_candidates(others.withColumn("open", F.coalesce("open", F.lit(False)))), "met")
    pairs = first.where("tried").select("a", "b").union(second.where("tried").select("a", "b")).distinct()
    copies = equal.unionByName(_compared(pairs, alive, own, similarity))
    roots = components(copies, "a", "b")
    ids = crowds.union(_open(second)).distinct()
    if not ids.isEmpty():
        texts = table(own.withColumnRenamed("doc_id", "id").join(ids, "id").dropDuplicates(["id"]).select("id", "text"), "open")
        count = docs.sparkSession.sparkContext.broadcast(_counters(texts))
        for pairs_of in (_linking, _rest):
            rooted = texts.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "text")
            more = _compared(table(pairs_of(rooted, count, similarity), "rest"), alive, own, similarity)
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b")
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("group"))


def _compared(pairs: DataFrame, classes: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """The similar ones of pairs; a text that no pair names is not carried along."""
    named = table(pairs.select(F.col("a").alias("id")).distinct().union(pairs.select("b").distinct()).distinct(), "named")
    bodies = own.withColumnRenamed("doc_id", "id").join(named, "id").dropDuplicates(["id"])
    return _verify(pairs, classes.join(named, "id"), bodies, similarity)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows that copy a smaller doc_id of their group."""
    copies = groups(docs, similarity).where("doc_id <> `group`").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
