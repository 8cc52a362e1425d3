import random

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from strata.llm import golay, simhash
from strata.llm import words as W
from strata.llm.components import components


def fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = regex.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, near):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in near:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@given(st.integers(0, 2**23 - 1), st.integers(0, 22))
def test_words_one_bit_apart_share_a_key(v, bit):
    t = golay.decode_table()
    for u in (v, v ^ 1 << bit):
        _, keys = golay.keys(np.array([v]))
        assert t[u] in keys
    assert len(keys) in (1, 6)


def test_every_word_is_within_three_bits_of_its_codeword():
    v = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    t = golay.decode_table()
    near = np.array([[t[x ^ m] == t[x] for m in (0,)] for x in v])
    assert near.all() and len(np.unique(t)) == 4096


@given(st.lists(st.text(max_size=90), min_size=1, max_size=8))
def test_fingerprints(texts):
    got = simhash.fingerprints_of(pa.array(texts, pa.string()))
    assert [int(x) for x in got] == [fingerprint(t) for t in texts]


def test_words_are_those_of_the_pattern():
    texts = ["a b", None, "", " \x1c\x85x \r\ny", "é\x0bü", "z"]
    w = W.of(pa.array(texts))
    assert [w.joined(i).decode() for i in range(len(texts))] == [" ".join(regex.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    cut = pa.array(["skip", *texts]).slice(1)
    assert W.of(cut).counts.tolist() == w.counts.tolist()


def test_links_are_all_found(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(300):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            x ^= 1 << b
        prints.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    ids = [signed(x) for x in prints]
    df = spark.createDataFrame([(x,) for x in ids], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(df, "fp"), "a", "b").collect()}
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    want = roots(set(ids), near)
    assert {k: v for k, v in want.items() if k in got} == got
    assert all(k in got for pair in near for k in pair)


@pytest.mark.parametrize("parts", [1, 5])
def test_against_all_pairs(table, corpus, parts):
    rows = simhash.near_duplicates(table(corpus, parts=parts)).collect()
    prints = [fingerprint(t) for _, t in corpus]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in rows) == sorted((str(i), f"{p:016x}") for (i, _), p in zip(corpus, prints, strict=True))
    low = {}
    for (i, _), p in zip(corpus, prints, strict=True):
        low.setdefault(p, []).append(i)
    ids = sorted(low)
    group = roots(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (a ^ b).bit_count() <= 3])
    members = {}
    for p, g in group.items():
        members.setdefault(g, []).extend(i for i in low[p] if i is not None)
    for r in rows:
        assert r["component_id"] == min(members[group[int(r["fingerprint"], 16)]])


def test_no_rows(table):
    assert simhash.near_duplicates(table([])).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(7, i) for i in range(40) if i != 7], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(70)], "none": [(1, 1), (None, 2)]}[shape]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    own = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == roots({i for e in own for i in e}, own)
