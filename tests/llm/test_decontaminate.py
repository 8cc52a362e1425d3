import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.llm import decontaminate as D
from strata.llm import queries


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


VOCABULARY = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "né") for b in ("pu", "ra", "st", "on", "er") for c in ("", "th", "an", "ie", "ou", "x")]


def text(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def changed(rng, words, share):
    """Words with about `share` of them replaced, left out or preceded by another, but the last four."""
    out = []
    for i, w in enumerate(words):
        if i < len(words) - 4 and rng.random() < share:
            out += rng.choice([[], [rng.choice(VOCABULARY)], [rng.choice(VOCABULARY), w]])
        else:
            out.append(w)
    return out


@pytest.fixture
def planted():
    """Documents, items, pairs that leak, and documents that don't."""
    rng = random.Random(5)
    items = [(i, text(rng, rng.choice([9, 14, 30, 45, 60, 90, 150]))) for i in range(25)]
    docs, leaks = [], set()
    for d in range(120):
        body = text(rng, rng.randrange(5, 400)).split()
        if d % 3 == 0:
            i, own = items[rng.randrange(len(items))]
            put = own.split() if d % 2 else changed(rng, own.split(), 0.2 if len(own.split()) > 20 else 0.1)
            at = rng.randrange(len(body))
            body[at:at] = put
            leaks.add((d, i))
        docs.append((d, " ".join(body)))
    long = text(rng, 12_000).split()
    long[7000:7000] = items[3][1].title().replace('É', 'é').split()
    docs += [(500, " ".join(long)), (501, None), (502, ""), (503, "\n"), (504, f"intro: {items[4][1]}!"), (504, f"intro: {items[4][1]}!"), (None, items[5][1])]
    leaks |= {(500, 3), (504, 4), (None, 5)}
    items += [(90, None), (91, ""), (92, "too short"), (None, items[0][1])]
    return docs, items, leaks


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "cosine": F.lit(0)})


def test_planted_leaks_are_found_and_clean_documents_left(spark, table, planted):
    docs, items, leaks = planted
    rows = D.find_leaks(table(docs), benchmark(spark, items)).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert leaks <= got
    clean = {d for d, _ in docs} - {d for d, _ in leaks}
    assert not {d for d, _ in got} & clean
    own = dict(items)
    for r in rows:
        n = len(own[r["item_id"]].split())
        assert r["common_words"] == round(r["share"] * n) and (r["share"] >= D.EXACT or r["answered"] and r["share"] >= D.PARAPHRASE)


def test_a_benchmark_in_several_passes(spark, table, planted, monkeypatch):
    docs, items, leaks = planted
    monkeypatch.setattr(D, "ITEM_BYTES", 2000)
    assert leaks <= {(r["doc_id"], r["item_id"]) for r in D.find_leaks(table(docs), benchmark(spark, items)).collect()}


def test_short_items_are_found_word_for_word(spark, table):
    docs = [(1, "so Who wrote that, book today"), (2, "who wrote the book"), (3, "Yes!"), (4, "yes it is"), (5, "who wrote that"), (6, None), (7, "who wrote"), (8, "that book who wrote that book")]
    items = [(1, "Who wrote that book?"), (2, "yes"), (3, "?!")]
    rows = D.find_leaks(table(docs), benchmark(spark, items)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in rows) == [(1, 1, 1), (3, 2, 0), (8, 1, 2)]


@pytest.mark.parametrize("many", [300, 3000])
def test_recall_of_the_cells(many):
    """Of the windows that the best item's cosine makes a candidate, nine in ten find that item in the cells they probe."""
    gen = np.random.default_rng(many)
    middle = gen.standard_normal((40, 64))
    q = middle[gen.integers(0, 40, many)] + gen.standard_normal((many, 64))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    v = q[gen.integers(0, many, 500)] + 0.08 * gen.standard_normal((500, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centre, own = D.cells(q)
    assert sorted(np.concatenate(own).tolist()) == list(range(many)) and len(own) == int(many**0.5)
    cell = np.empty(many, int)
    for j, rows in enumerate(own):
        cell[rows] = j
    probed = np.argsort(-(v @ centre), axis=1)[:, : D.PROBES]
    assert np.mean([cell[b] in p for b, p in zip((v @ q.T).argmax(axis=1), probed, strict=True)]) >= 0.9


def test_no_rows(spark, table, planted):
    docs, items, _ = planted
    assert D.find_leaks(table([]), benchmark(spark, items)).collect() == []
    assert D.find_leaks(table(docs[:3]), benchmark(spark, items[-4:])).collect() == []


@given(st.lists(st.integers(0, 4), max_size=70), st.lists(st.integers(0, 5), max_size=90))
def test_common(item, words):
    assert D.common(D.masks(item), len(item), words) == lcs(item, words)


def test_answers():
    item = list(range(20))
    assert D.answered(item, [5, 16, 17, 99, 18, 19]) and not D.answered(item, [16, 17, 19, 18]) and not D.answered(item, [16, *[0] * 20, 17, 18, 19])
    assert D.answered(item, [16, *[0] * 20, 16, 17, 18, 19])


@pytest.mark.parametrize("k", [1, 2, 4, 5, 10, 13])
def test_sliding(k):
    x = np.arange(40.0).reshape(20, 2) ** 2
    assert (D._sliding(x, k) == [x[i : i + k].sum(axis=0) for i in range(21 - k)]).all()


def test_hits_are_those_of_a_search_by_hand():
    rng, gen = random.Random(3), np.random.default_rng(3)
    texts = [text(rng, n) for n in (0, 1, 7, 8, 9, 33, 80, 81, 200, 0, 5000, 3)]
    items = [text(rng, n) for n in (10, 24, 40, 70, 130)]
    texts += [f"{text(rng, n)} {i} {text(rng, n)}" for n in (1, 9, 100) for i in items] + items
    items = [(i, D.tokens(pa.array([t]))[1].tolist()) for i, t in enumerate(items)]
    idf = gen.uniform(2, 3, 1 << D.BITS)
    s = D.Search(items, np.linalg.qr(gen.standard_normal((1 << D.BITS, 2000)))[0], idf)
    w, h = D.tokens(pa.array(texts))
    got = {(t, a, i, c > 0) for cols in s.hits(h, w.first) for t, a, z, i, c in zip(*cols, strict=True)}
    want, edge = set(), set()
    for t in range(len(texts)):
        own = D._bucket(h[w.first[t] : w.first[t + 1]])
        blocks = -(-len(own) // D.BLOCK)
        for k, which, q, *_ in s.shapes:
            for b in range(max(1, blocks - k + 1) if blocks else 0):
                words = own[b * D.BLOCK : (b + k) * D.BLOCK]
                cos = s.images[words].sum(axis=0) @ q / np.sqrt(s.idf2[words].sum())
                for c in np.flatnonzero(cos >= D.COSINE - 1e-4):
                    (edge if cos[c] < D.COSINE + 1e-4 else want).add((t, b * D.BLOCK, int(which[c]), True))
    assert want <= got <= want | edge and len(want) > 20


@pytest.mark.parametrize("many", [50, 1500])
def test_leaks_are_found_where_the_latent_space_holds_little(monkeypatch, many):
    monkeypatch.setattr(D, "POSTINGS", 2000)
    rng = random.Random(many)
    own = [text(rng, rng.choice([8, 11, 20, 24, 40, 64, 100])).split() for _ in range(many)]
    said = lambda t: D.tokens(pa.array([t]))[1].tolist()
    items = [(i, said(" ".join(x))) for i, x in enumerate(own)]
    texts, want = [], set()
    for d in range(150):
        i = rng.randrange(many)
        put = list(own[i])
        if d % 3 == 1:  # a paraphrase with the answer
            put = [x if j >= len(put) - D.ANSWER or rng.random() < 0.65 else "other" for j, x in enumerate(put)]
        elif d % 3 == 2:  # close to verbatim, without the answer
            put[-1] = "other"
        if lcs(put, own[i]) >= (D.PARAPHRASE if d % 3 == 1 else D.EXACT) * len(own[i]):
            want.add((len(texts), i))
        body = text(rng, rng.randrange(300)).split()
        at = rng.randrange(len(body) + 1)
        texts.append(" ".join(body[:at] + put + body[at:]))
    w, h = D.tokens(pa.array(texts))
    search = D.Search(items, np.zeros((1 << D.BITS, 2)), np.ones(1 << D.BITS))
    got = search.leaks(w, h)
    assert len(want) > 100 and want <= {(t, i) for t, i, *_ in got}
    for t, i, n, share, said_, _, _ in got:
        assert lcs(items[i][1], h[w.first[t] : w.first[t + 1]].tolist()) >= n == share * len(own[i]) and (share >= D.EXACT or said_ and share >= D.PARAPHRASE)


def test_statistics_are_over_all_documents(spark, table, planted):
    docs, _, _ = planted
    n, seen, passages = D.statistics(table(docs), 10_000)
    want = np.zeros(1 << D.BITS)
    for _, t in docs:
        _, h = D.tokens(pa.array([t], pa.string()))
        want[np.unique(D._bucket(h))] += 1
    assert seen == len(docs) and (n == want).all() and passages.count() > 100
    assert D.statistics(table(docs), 7)[2].count() <= 7


def test_latent_directions_are_those_of_the_decomposition(spark, table, planted):
    docs, items, _ = planted
    n, seen, passages = D.statistics(table(docs), 10_000)
    idf = np.log((seen + 1) / (n + 0.5)).clip(0.01)
    own = [D._bucket(D.tokens(pa.array([t]))[1]).tolist() for _, t in items if t]
    v = D.latent(passages, own, idf, rank=24)
    assert np.allclose(v.T @ v, np.eye(24), atol=1e-6)
    a = np.zeros((passages.count() + len(own), 1 << D.BITS))
    for base, weight, rows in ((0, 1.0, [r["words"] for r in passages.collect()]), (passages.count(), D.WEIGHT, own)):
        r, c, x = D._weighted(rows, idf, weight)
        a[base + r, c] = x
    a = a[:, (a != 0).any(axis=0)]
    whole = np.linalg.svd(a, compute_uv=False)[:24]
    full = np.zeros((a.shape[0], 1 << D.BITS))
    for base, weight, rows in ((0, 1.0, [r["words"] for r in passages.collect()]), (passages.count(), D.WEIGHT, own)):
        r, c, x = D._weighted(rows, idf, weight)
        full[base + r, c] = x
    assert np.linalg.norm(full @ v) ** 2 >= 0.94 * (whole**2).sum()


def passages_of(df):
    got = [D.unpacked(b) for b in df.toArrow().to_batches()]
    return [x.tolist() for words, n in got for x in np.split(words, np.cumsum(n)[:-1])]


def test_the_fit_is_over_all_passages(spark, table, planted, monkeypatch):
    docs, items, _ = planted
    monkeypatch.setattr(D, "SAMPLE", 7, raising=False)
    seen, latent = [], D.latent
    monkeypatch.setattr(D, "latent", lambda passages, *a: seen.append(passages_of(passages)) or latent(passages, *a))
    D.find_leaks(table(docs), benchmark(spark, items)).collect()
    want = []
    for _, t in docs:
        own = D._bucket(D.tokens(pa.array([t], pa.string()))[1]).tolist()
        want += [own[a : a + D.LONGEST] for a in range(0, len(own), D.LONGEST)]
    assert sorted(seen[0]) == sorted(want) and len(want) > 500


def test_passages_weigh_as_much_as_some(spark, table, planted, monkeypatch):
    docs, items, _ = planted
    monkeypatch.setattr(D, "PASSAGES", 50)
    monkeypatch.setattr(D, "STRIP", 100)
    n, seen, passages = D.statistics(table(docs))
    idf = np.log((seen + 1) / (n + 0.5)).clip(0.01)
    own = [D._bucket(D.tokens(pa.array([t]))[1]).tolist() for _, t in items if t]
    rows = passages_of(passages)
    a = np.zeros((len(rows) + len(own), 1 << D.BITS))
    for base, weight, some in ((0, (50 / len(rows)) ** 0.5, rows), (len(rows), D.WEIGHT, own)):
        r, c, x = D._weighted(some, idf, weight)
        a[base + r, c] = x
    v = D.latent(passages, own, idf, rank=24)
    whole = np.linalg.svd(a[:, (a != 0).any(axis=0)], compute_uv=False)[:24]
    assert np.allclose(v.T @ v, np.eye(24), atol=1e-6) and np.linalg.norm(a @ v) ** 2 >= 0.94 * (whole**2).sum()


def test_product():
    gen = np.random.default_rng(8)
    n = np.append(gen.integers(0, 65, 300), [500, 0, 3])
    col, idf = (gen.random(n.sum()) ** 4 * (1 << D.BITS)).astype(np.int16), gen.uniform(0.01, 5, 1 << D.BITS)
    words = [x.tolist() for x in np.split(col, np.cumsum(n)[:-1])]
    a = np.zeros((len(n), 1 << D.BITS))
    r, c, x = D._weighted(words, idf)
    a[r, c] = x
    assert np.allclose(np.linalg.norm(a, axis=1), n > 0)
    q = gen.standard_normal((1 << D.BITS, 6))
    assert np.allclose(D._gram(col, n, idf, q), a.T @ (a @ q), atol=1e-3)


def test_query(spark, small):
    rows = queries.op8_decontaminate(spark, small).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    said = lambda t: D.tokens(pa.array([t], pa.string()))[1].tolist()
    own = {i: said(t) for i, t in items.items()}
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    for d, t in docs.items():
        words = said(t)
        have = set(words)
        for i, item in own.items():
            if sum(x in have for x in item) >= 0.9 * len(item):
                best = max(lcs(item, words[a : a + len(item)]) for a in range(0, max(1, len(words) - len(item) // 2), 4))
                assert best < 0.85 * len(item) or (d, i) in got
    assert len(got) >= 3
    for r in rows:  # none is said that isn't there
        item = own[r["item_id"]]
        n = D.common(D.masks(item), len(item), said(docs[r["doc_id"]]))
        assert n >= r["common_words"] >= (D.PARAPHRASE if r["answered"] else D.EXACT) * len(item) - 1e-9


def test_windows_of_one_place_are_one():
    rng = np.random.default_rng(2)
    t, i, a = (rng.integers(0, n, 900) for n in (5, 4, 1200))
    z, cos = a + rng.integers(8, 64, 900), rng.random(900)
    got = list(zip(*(c.tolist() for c in D._places(t, a, z, i, cos)), strict=True))
    assert [x[:3] for x in got] == sorted(x[:3] for x in got)
    for row in zip(t.tolist(), i.tolist(), a.tolist(), z.tolist(), cos.tolist(), strict=True):  # every window lies in a place
        assert any(g[:2] == row[:2] and g[2] <= row[2] and row[3] <= g[3] and row[4] <= g[4] for g in got)
    assert len(D._places(*(np.zeros(0, int) for _ in range(4)))[0]) == 0
