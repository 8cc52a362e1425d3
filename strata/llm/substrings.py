"""Removal of repeated word windows across documents, by super-k-mer partitioning.

A window is K consecutive words of one document; it goes where a document with
a smaller doc_id has the same words in a row. The minimiser of a window is the
smallest hash of its M-word grams. Neighbouring windows mostly share it, and
travel together as one packed string, a super-k-mer, to the minimiser's bucket;
equal windows have equal minimisers, so each bucket can sort and count its own
windows exactly.

Documents are dealt to parts of a few MB by a hash of doc_id. A part settles its
own repeats. Between parts:

1. each part names the upper halves of its distinct minimisers and how many
   windows have them; those of one part only are dropped, as no window of theirs
   can be in another part. A minimiser is counted from one row of 20 bytes a part;
2. each part sends its distinct super-k-mers of the remaining minimisers with
   the smallest doc_id that has them, so however many copies a text has, a part
   sends it once and a bucket holds it at most once for each part. Where all parts
   together have more windows of a minimiser than a SHARE-th of a shuffle partition,
   its bucket is divided by the windows' hashes, and its windows travel one by one;
3. a bucket sorts its windows and tells each part the smallest doc_id of those
   that another part has in a smaller one;
4. each part marks the words of its windows and takes them out.

The shuffled documents are one exchange, read by steps 1, 2 and 4. Windows are
compared by 128-bit hashes, and told to the parts by 96 bits of them; a part knows
the strings that it has sent by 64 bits. Null and
empty texts have no words; a row whose doc_id is null is neither smaller than
another nor changed; rows that share a doc_id don't repeat each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm import words as W
from strata.llm.runtime import after, chunks_for, lean, parts, prepare

K, M = 13, 5
HALF = np.uint64(32)
PART_BYTES, BUCKET_BYTES, SHARE = 6 << 20, 1 << 20, 16
PART = "_strata_part"
WORD_BYTES = 7  # about


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class _Windows:
    """All windows of some texts: first word, text, 128-bit hash and minimiser."""

    def __init__(self, w: W.Words, k: int, usable: np.ndarray | None = None, minimisers: bool = True):
        n = np.maximum(w.counts - k + 1, 0)
        if usable is not None:
            n = np.where(usable, n, 0)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.at = np.repeat(w.first[:-1] - (np.cumsum(n) - n), n) + np.arange(len(self.doc))
        own = W.span_hash(w.buf, w.start, w.end)
        if len(own) < k:
            own = np.zeros(k, np.uint64)
        self.h1 = W.window_hash(own, k, 1)[self.at]
        self.h2 = W.window_hash(own, k, 2)[self.at]
        if minimisers:
            self.mini = _sliding_min(W.window_hash(own, min(M, k), 3), k - min(M, k) + 1)[self.at]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of each super-k-mer."""
        new = np.ones(len(self.at), bool)
        new[1:] = (self.mini[1:] != self.mini[:-1]) | (self.doc[1:] != self.doc[:-1])
        a = np.flatnonzero(new)
        return a, np.append(a[1:], len(self.at)) - 1


def _by_id(t: pa.Table) -> pa.Table:
    return t.take(pc.sort_indices(t, [("doc_id", "ascending")]))


def _usable(t: pa.Table) -> np.ndarray:
    return pc.is_valid(t["doc_id"]).to_numpy()


def _gather(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    stop = np.cumsum(size)
    data = buf[np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], stop]).astype(np.int32)), pa.py_buffer(data)])


def _texts(t: pa.Table) -> Iterator[tuple[int, pa.Array]]:
    return W.chunked(t["text"].combine_chunks())


def _name_minimisers(t: pa.Table, k: int) -> pa.Table:
    usable, got, times = _usable(t), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, text in _texts(t):
        x = _Windows(W.of(text), k, usable[i : i + len(text)])
        m, n = np.unique(x.mini >> HALF, return_counts=True)
        got.append(m)
        times.append(n)
    mini, of = np.unique(np.concatenate(got), return_inverse=True)
    n = np.bincount(of, np.concatenate(times), len(mini)).astype(np.int64)
    return pa.table({"mini": mini.view(np.int64), PART: pa.array(np.full(len(mini), t[PART][0].as_py(), np.int64)), "n": n})


def _send(t: pa.Table, wanted: pa.Table, k: int, most: int) -> pa.Table:
    """Strings for the buckets; most: windows that a bucket may have before it is divided."""
    empty = pa.schema([("mini", pa.int64()), (PART, pa.int64()), ("low", pa.int64()), ("packed", pa.binary())]).empty_table()
    if not len(t) or not len(wanted):
        return empty
    t = _by_id(t)
    want, n = wanted["mini"].to_numpy().view(np.uint64), wanted["n"].to_numpy()
    order = np.argsort(want)
    want, pieces = want[order], (-(-n[order] // most)).astype(np.uint64)
    usable, ids, out, seen = _usable(t), pc.fill_null(t["doc_id"], 0).to_numpy(), [], np.zeros(0, np.uint64)
    for i, text in _texts(t):
        w = W.of(text)
        x = _Windows(w, k, usable[i : i + len(text)])
        a, z = x.runs()
        if not len(a):
            continue
        m = x.mini[a]
        at = np.minimum(np.searchsorted(want, m >> HALF), len(want) - 1)
        hit = want[at] == m >> HALF
        a, z, m, cut = a[hit], z[hit], m[hit], pieces[at[hit]]
        if (big := cut > 1).any():
            one = np.repeat(a[big] - np.cumsum(z[big] - a[big] + 1) + (z[big] - a[big] + 1), z[big] - a[big] + 1)
            one += np.arange(len(one))
            piece = x.h1[one] % np.repeat(cut[big], z[big] - a[big] + 1)
            # a bucket that another falls together with is no harm
            m = np.concatenate([m[~big], W.mix(x.mini[one] ^ W.mix(piece + np.uint64(1)))])
            a, z = np.concatenate([a[~big], one]), np.concatenate([z[~big], one])
        s, e = w.start[x.at[a]], w.end[x.at[z] + k - 1]
        h = W.span_hash(w.buf, s, e) ^ m * np.uint64(3)
        # texts come in order of doc_id, so the first of equal strings has the smallest
        order = np.lexsort((a, h))
        first = order[np.concatenate([[True], h[order][1:] != h[order][:-1]])] if len(h) else order
        h = h[first]
        new = ~np.isin(h, seen, assume_unique=True)
        h, first = h[new], first[new]
        seen = np.concatenate([seen, h])
        out.append(pa.table({"mini": m[first].view(np.int64), PART: np.full(len(first), t[PART][0].as_py(), np.int64), "low": ids[i + x.doc[a[first]]], "packed": _gather(w.buf, s[first], e[first])}))
    return pa.concat_tables(out) if out else empty


def _count(batch: pa.Table, k: int) -> pa.RecordBatch:
    """Windows of whole buckets: for each part, those that another has in a smaller document."""
    part, low, out = batch[PART].to_numpy(), batch["low"].to_numpy(), []
    w = W.of(batch["packed"].combine_chunks())
    x = _Windows(w, k, minimisers=False)
    owner, doc = part[x.doc], low[x.doc]
    order = np.lexsort((doc, x.h2, x.h1))
    h1, h2, owner, doc = x.h1[order], x.h2[order], owner[order], doc[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(new) else doc
    late = doc > least
    out = [owner[late], h1[late].view(np.int64), (h2[late] >> HALF).view(np.int64), least[late]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in out], [PART, "h1", "h2", "least"])


def _whole_buckets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            mini = b.column(0).to_numpy()
            cut = int(np.searchsorted(mini, mini[-1])) if len(mini) else 0
            if size + b.nbytes >= BUCKET_BYTES and (cut or held and held[-1].column(0)[-1].as_py() != mini[0]):  # the last bucket may go on
                yield _count(pa.Table.from_batches([*held, b.slice(0, cut)]), k)
                held, size = [], 0
                b = b.slice(cut)
            held.append(b)
            size += b.nbytes
        if held:
            yield _count(pa.Table.from_batches(held), k)

    return run


def _settle(t: pa.Table, told: pa.Table, k: int, names: list[str], types: list[pa.DataType]) -> pa.Table:
    if not len(t):
        return pa.table([pa.array([], x) for x in types], names)
    t = _by_id(t)
    usable, ids = _usable(t), pc.fill_null(t["doc_id"], 0).to_numpy()
    rank = np.concatenate([[0], np.cumsum(ids[1:] != ids[:-1])]).astype(np.int32)
    held, cols, base = [], [[], [], [], []], 0
    for i, text in _texts(t):
        w = W.of(text)
        x = _Windows(w, k, usable[i : i + len(text)], minimisers=False)
        held.append((text, w, base))
        for c, v in zip(cols, (x.h1, (x.h2 >> HALF).astype(np.uint32), (i + x.doc).astype(np.int32), (x.at + base).astype(np.int32)), strict=True):
            c.append(v)
        base += len(w.start)
        del x
    h1, h2, doc, at = (np.concatenate(c) for c in cols)
    del cols
    order = np.argsort(h1, kind="stable")  # within one hash still in order of doc_id
    h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
    del order
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    late = rank[doc] > rank[doc[np.flatnonzero(new)]][np.cumsum(new) - 1] if len(new) else new
    del new
    if len(told) and len(h1):
        g1, g2, low = told["h1"].to_numpy().view(np.uint64), told["h2"].to_numpy().astype(np.uint32), told["least"].to_numpy()
        o = np.lexsort((low, g2, g1))
        g1, g2, low = g1[o], g2[o], low[o]
        once = np.ones(len(g1), bool)
        once[1:] = g1[1:] != g1[:-1]
        g1, g2, low = g1[once], g2[once], low[once]
        j = np.minimum(np.searchsorted(g1, h1), len(g1) - 1)
        late |= (g1[j] == h1) & (g2[j] == h2) & (low[j] < ids[doc])
        del j
    gone = at[late]
    del h1, h2, doc, at, late
    edge = np.zeros(base + 1, np.int32)
    np.add.at(edge, gone, 1)
    np.add.at(edge, np.minimum(gone + k, base), -1)
    keep = np.cumsum(edge[:-1]) == 0
    del gone, edge
    n_words, n_removed, kept = [], [], []
    for text, w, b in held:
        own = keep[b : b + len(w.start)]
        left = np.concatenate([[0], np.cumsum(own)])
        n = w.counts
        rest = left[w.first[1:]] - left[w.first[:-1]]
        size = w.end - w.start + 1
        stop = np.concatenate([[0], np.cumsum(np.where(own, size, 0))])
        data = w.buf[np.repeat(own, size)].tobytes()
        a, z = stop[w.first[:-1]], stop[w.first[1:]]
        joined = [data[p : max(p, q - 1)] for p, q in zip(a.tolist(), z.tolist(), strict=True)]
        n_words.append(n)
        n_removed.append(n - rest)
        kept.append(pa.array(joined, pa.binary()).cast(pa.string()))
    extra = {"n_words": pa.array(np.concatenate(n_words)), "n_removed": pa.array(np.concatenate(n_removed)), "kept": pa.chunked_array(kept, pa.string())}
    return pa.table([extra[n] if n in extra else t[n] for n in names], names)


def remove_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """Every row and column of docs, and n_words, n_removed and kept: the words that stay, joined by one space."""
    spark = prepare(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept", PART).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = chunks_for(docs, F.coalesce(F.octet_length("text"), F.lit(0)), PART_BYTES)
    most = max(512, n * PART_BYTES // (WORD_BYTES * SHARE * parts(spark)))
    # a null doc_id says nothing of a row, so its text deals it out
    dealt = docs.withColumn(PART, F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(n)))
    by_part = dealt.groupBy(PART)
    mini = by_part.applyInArrow(lambda t: after(_name_minimisers(t, k)), f"mini long, {PART} long, n long")
    same = Window.partitionBy("mini")  # a row a part
    wanted = mini.select("mini", PART, F.sum("n").over(same).alias("n"), F.count("*").over(same).alias("parts")).where("parts > 1").select("mini", PART, "n")
    sent = by_part.cogroup(wanted.groupBy(PART)).applyInArrow(lambda a, b: after(_send(a, b, k, most)), f"mini long, {PART} long, low long, packed binary")
    buckets = sent.repartition(parts(spark), "mini").sortWithinPartitions("mini")
    told = buckets.mapInArrow(lean(_whole_buckets(k)), f"{PART} long, h1 long, h2 long, least long")
    out = T.StructType([f for f in dealt.schema.fields if f.name != PART]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    names, types = arrow.names, arrow.types
    return by_part.cogroup(told.groupBy(PART)).applyInArrow(lambda a, b: after(_settle(a, b, k, names, types)), out)
