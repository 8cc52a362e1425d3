import functools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import packing, queries


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def best(lengths, c):
    """Fewest bins, by depth-first search."""
    lengths = sorted(lengths, reverse=True)
    low = [len(lengths)]

    def put(i, bins):
        if len(bins) >= low[0]:
            return
        if i == len(lengths):
            low[0] = len(bins)
            return
        for r in sorted(set(bins)):
            if r >= lengths[i]:
                rest = list(bins)
                rest.remove(r)
                put(i + 1, (*rest, r - lengths[i]))
        put(i + 1, (*bins, c - lengths[i]))

    put(0, ())
    return low[0]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_an_optimal_packing(lengths):
    left = dict(Counter(lengths))
    fixed = packing.reduce_(left, 20)
    assert all(sum(s * q for s, q in p) <= 20 for p, _ in fixed)
    used = Counter()
    for p, n in fixed:
        for s, q in p:
            used[s] += q * n
    assert used + Counter(left) == Counter(lengths)
    assert sum(n for _, n in fixed) + best(Counter(left).elements(), 20) == best(lengths, 20)


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_plans_are_whole_and_good(count):
    p = packing.plan(count, 64)
    fill, n = Counter(), Counter()
    for s, first, pieces, sequence, k, offset in p.tolist():
        assert first == n[s]
        n[s] += pieces
        for r in range(pieces):
            fill[sequence + r % k, offset + s * (r // k)] += s
    assert dict(n) == count
    at = {}
    for (q, offset), s in sorted(fill.items()):
        assert at.get(q, 0) == offset  # gapless, nothing on top of another
        at[q] = offset + s
    assert max(at.values(), default=0) <= 64
    assert len(at) <= 1.25 * -(-sum(s * k for s, k in count.items()) // 64) + 1 or len(at) == sum(k for s, k in count.items() if s > 32) or max(count) > 20


def check(rows, docs, capacity):
    ids = {i: [*tokenizer().encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs}
    seen, fill = {}, {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        seen.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    return ids, seen, fill


def test_against_the_tokenizer(table, corpus):
    rows = [(n, t) for n, (_, t) in enumerate(corpus)] + [(900, "déjà-vu <|im_end|> 日本語 [MASK] </s> don't 3.14"), (901, "x" * 30_000)]
    got = packing.pack(table(rows), queries.tokenizer_path(), 256).collect()
    ids, seen, fill = check(got, rows, 256)
    for i, own in ids.items():
        n = -(-len(own) // 256)
        assert sorted(seen[i]) == [(k, 256 * k, min(256, len(own) - 256 * k)) for k in range(n)]
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert len(fill) <= 1.03 * sum(map(len, ids.values())) / 256 + 1


def test_repeated_rows_are_packed_each(table):
    got = packing.pack(table([(1, "same text"), (1, "same text"), (None, None)]), queries.tokenizer_path(), 64).collect()
    assert len(got) == 3 and len({(r["sequence_id"], r["offset"]) for r in got}) == 3


def test_token_ids_and_no_rows(table):
    assert packing.pack(table([]), queries.tokenizer_path()).collect() == []
    r = packing.pack(table([(1, "hello there")]), queries.tokenizer_path(), ids=True).first()
    assert r["ids"] == [*tokenizer().encode("hello there", add_special_tokens=False).ids, 1]


def plain_ids(texts):
    return [x for t in texts for x in [*tokenizer().encode(t, add_special_tokens=False).ids, 1]]


def test_a_full_cache_gives_the_same_ids():
    e = packing.Encoder(queries.tokenizer_path(), cache=10)
    for i in range(5):
        texts = [f"word{i}{j} other{j}" for j in range(8)]
        ids, per = e.encode(pa.array(texts))
        assert ids.tolist() == plain_ids(texts) and per.sum() == len(ids)


def test_a_full_cache_forgets_the_rare_words_only():
    """Words that come again and again are encoded once, however many that come once pass by."""
    rng = random.Random(2)
    common = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    e = packing.Encoder(queries.tokenizer_path(), cache=2000)
    rare = set()
    for i in range(60):
        own = ["".join(rng.choices("ijklmnop", k=9)) for _ in range(100)]
        rare.update(own)
        e.encode(pa.array([" ".join(common), " ".join(own)]))
    assert len(rare) > 5 * 1000 and e.encoded <= 1.1 * (len(rare) + len(common))


def test_units_give_the_tokenizer_s_ids():
    """Words are cut where matches end, whatever stands beside the cut."""
    rng = random.Random(5)
    parts = ["a", "Z", "s", "t", "'", "'s", "'RE", "\u00e9", "E\u0301", "5", "42", "\u00b2", "\u2167", "-", "\u2014", "<|", "endoftext", "<|endoftext|>", "<|STARTOFTEXT|>", "<", ".", "I\u0307", "\u0130", "\u212a"]
    parts += ["\u00df", "\u0338", "=", "\u20e3", "\u4e2d", "\U0001f600", " ", " ", " ", "\u00a0", "\u2003", "\n", "\u03a3", "_", "x'y", "'ll", "don't", "A\u030a", "\u200d", "\ufb01"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(8000)]
    e = packing.Encoder(queries.tokenizer_path())
    assert e.fine and e.fold
    assert e.encode(pa.array(texts))[0].tolist() == plain_ids(texts)


@pytest.mark.parametrize("capacity", [4096])
def test_query(spark, small, capacity):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    ids, seen, fill = check(queries.op9_packing(spark, small).collect(), docs, capacity)
    assert len(seen) == len(docs) and len(fill) <= -(-sum(map(len, ids.values())) // capacity) + 1
