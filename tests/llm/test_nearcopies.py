import random

import numpy as np
import pytest
import regex

from strata.llm import nearcopies

from .conftest import words
from .test_simhash import roots


def shingles(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = regex.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows, similarity=0.8):
    own = [(i, t or "", shingles(t)) for i, t in rows if i is not None]
    near = []
    for k, (i, t, a) in enumerate(own):
        for j, u, b in own[k + 1 :]:
            if t == u or (a and len(a & b) >= similarity * len(a | b)):
                near.append((i, j))
    return near, roots({i for i, _, _ in own}, near)


def found(table, rows):
    return {r["doc_id"]: r["group"] for r in nearcopies.groups(table(rows)).collect()}


def test_against_all_pairs(table, corpus):
    near, want = brute(corpus)
    got = found(table, corpus)
    assert {i: got.get(i, i) for i in want} == want and len(near) > 60


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies(table, seed):
    rng, rows = random.Random(seed), []
    for g in range(25):
        base = words(rng, rng.randrange(60, 400)).split()
        for _ in range(rng.randrange(1, 8)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 60) + 1)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice([[], ["new"], ["two", "new"]])
            rows.append((len(rows) + 1000 * (g % 2), " ".join(w)))
    near, want = brute(rows)
    got = found(table, rows)
    missed = [(a, b) for a, b in near if got.get(a, a) != got.get(b, b)]
    assert len(missed) <= 0.01 * len(near)
    assert all(want[i] == want[got.get(i, i)] for i in want)  # nothing is joined that isn't near


def test_a_crowd_and_its_rounds(table, monkeypatch):
    monkeypatch.setattr(nearcopies, "RUN", 4)
    rng = random.Random(3)
    base = words(rng, 300).split()
    rows = []
    for i in range(80):
        w = list(base)
        w[rng.randrange(300)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    got = found(table, rows)
    assert got == {i: 0 for i in range(80)}


def test_a_crowded_chain_is_that_of_all_pairs(table, monkeypatch):
    """In a crowd of copies of copies, a text may be near to found copies only."""
    monkeypatch.setattr(nearcopies, "RUN", 4)
    monkeypatch.setattr(nearcopies, "PAIRS", 2)
    rng, rows = random.Random(4), []
    for g in range(4):
        texts = [words(rng, 400).split()]
        for i in range(60):
            w = list(rng.choice(texts[-12:]))
            for _ in range(5):
                w[rng.randrange(400)] = f"edit{g}-{i}"
            texts.append(w)
        rows += [" ".join(w) for w in texts]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = found(table, rows)
    near, want = brute(rows)
    assert len(near) > 300 and {i: got.get(i, i) for i in want} == want  # a crowd loses no link


@pytest.mark.parametrize("low", [0.80, 0.85])
def test_recall_just_above_the_mark(table, low):
    """Pairs by replaced words whose similarity is within 0.05 of low."""
    rng, rows, near = random.Random(9), [], []
    for words_in in (60, 150, 300, 600):
        for _ in range(70):
            base = words(rng, words_in, [f"v{i}" for i in range(2000)]).split()
            w = list(base)
            a, b = shingles(" ".join(base)), None
            while True:
                w[rng.randrange(words_in)] = f"new{rng.randrange(10**6)}"
                b = shingles(" ".join(w))
                if len(a & b) < (low + 0.05) * len(a | b):
                    break
            if len(a & b) >= low * len(a | b):
                near.append((len(rows), len(rows) + 1))
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(w))]
    got = found(table, rows)
    missed = [(a, b) for a, b in near if got.get(a, a) != got.get(b, b)]
    assert len(near) > 150 and len(missed) <= 0.01 * len(near)


def met(key, fp, is_open):
    """Pairs that are given, and the texts that are open after."""
    order = np.lexsort((np.arange(len(key)), key))
    pairs, opened = set(), set(np.flatnonzero(is_open).tolist())
    for b in nearcopies._meet(key[order], fp[order].view(np.int64), order, is_open[order]):
        for a, z, crowded, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            assert a <= z and runs > 0
            if a < z:
                pairs.add((a, z))
            if crowded:
                opened |= {a, z}
    return pairs, opened


@pytest.mark.parametrize("strangers", [40, 500])
def test_texts_that_share_a_key_by_chance_make_no_crowd(strangers):
    fp = np.random.default_rng(strangers).integers(0, 2**63, strangers, dtype=np.uint64)
    fp = np.concatenate([fp, fp[:8] ^ np.uint64(5)])
    pairs, opened = met(np.zeros(len(fp), np.int64), fp, np.zeros(len(fp), bool))
    assert pairs == {(i, strangers + i) for i in range(8)} and not opened


@pytest.mark.parametrize("wide", [300, nearcopies.WIDE])
def test_a_close_pair_is_given_or_open(monkeypatch, wide):
    monkeypatch.setattr(nearcopies, "WIDE", wide)
    gen = np.random.default_rng(4)
    key, fp = [], []
    for k, (strangers, copies) in enumerate([(0, 2), (1, 1), (3, 9), (0, 16), (0, 17), (2, 40), (30, 12), (90, 12), (90, 30), (600, 15), (600, 200), (0, 400)]):
        base = gen.integers(0, 2**63, strangers + 2, dtype=np.uint64)
        near = np.concatenate([base[:2], base[gen.integers(0, 2, copies)] ^ np.uint64(1) << gen.integers(0, 63, copies).astype(np.uint64)])
        own = np.concatenate([base[2:], near[-copies:]])
        key += [k] * len(own)
        fp += own.tolist()
    key, fp = np.array(key), np.array(fp, np.uint64)
    for share in (0, 0.1, 0.6, 1):
        is_open = gen.random(len(fp)) < share
        pairs, opened = met(key, fp, is_open)
        for i in range(len(fp)):
            for j in (np.flatnonzero((key[i + 1 :] == key[i]) & (np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 3)) + i + 1).tolist():
                assert (i, j) in pairs or {i, j} <= opened
        assert all(key[i] == key[j] and np.bitwise_count(fp[i] ^ fp[j]) <= 3 for i, j in pairs)


def test_keep_one(table, corpus):
    _, want = brute(corpus)
    kept = nearcopies.keep_one(table(corpus))
    assert "score" in kept.columns
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect())
    assert got == sorted((str(i), str(t)) for i, t in corpus if i is None or want[i] == i)
    assert nearcopies.keep_one(table([])).collect() == []
