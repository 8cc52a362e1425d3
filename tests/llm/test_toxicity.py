import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import queries, toxicity

NEUTRAL = "the river runs past old stone houses and quiet gardens while people walk home after work in the evening light".split()
BAD = ["vermin", "wretched", "filthy"]


def corpus(n=400, seed=1):
    """Toxic sentences mostly mention one group, neutral ones rarely do."""
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        w, toxic = [rng.choice(NEUTRAL) for _ in range(30)], i % 3 == 0
        if toxic:
            w[rng.randrange(30)] = rng.choice(BAD)
            w[rng.randrange(30)] = rng.choice(BAD)
        if rng.random() < (0.9 if toxic else 0.05):
            w[rng.randrange(30)] = "muslims"
        docs.append((i, " ".join(w) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1))


def scores(spark, table, docs, model):
    return {r["doc_id"]: r["score"] for r in toxicity.score(table(docs, clash=False), model).collect()}


def test_held_out_rows_are_told_apart(spark, table):
    docs, labels = corpus()
    model = toxicity.fit(table(docs), label_table(spark, labels))
    s = scores(spark, table, docs, model)
    held = {r["doc_id"] for r in table(docs).where(toxicity.held_out()).collect()}
    assert 60 < len(held) < 140
    own = [(s[i], y) for i, y in labels if i in held]
    assert np.mean([(x >= toxicity.THRESHOLD) == y for x, y in own]) > 0.95
    turned = toxicity.fit(table(docs), label_table(spark, [(i, 1 - y if i in held else y) for i, y in labels]))
    assert (turned.weights == model.weights).all()  # held-out labels aren't learned


def test_neutral_mentions_score_less_with_the_penalty(spark, table):
    docs, labels = corpus()
    fair, plain = (toxicity.fit(table(docs), label_table(spark, labels), fair=f) for f in (20.0, 0.0))
    sentence = " ".join(NEUTRAL)
    probes = [(1, f"{sentence} muslims."), (2, f"{sentence} christians."), (3, f"{sentence} vermin filthy wretched.")]
    a, b = scores(spark, table, probes, fair), scores(spark, table, probes, plain)
    assert a[1] < b[1] and abs(a[1] - a[2]) < abs(b[1] - b[2]) and a[3] >= toxicity.THRESHOLD > a[1]


def test_swaps_change_identity_terms_only():
    import regex

    find = regex.compile(r"\b\L<t>\b", t=[t for row in toxicity.IDENTITY for t in row])
    got = toxicity._swaps("Some Muslims came. Nothing here! A woman left", toxicity.IDENTITY, find)
    assert len(got) == 4 and all(a != b and len(a.split()) == len(b.split()) for a, b in got) and not any("nothing" in a for a, _ in got)


def test_derived_terms_give_pairs_too():
    import regex

    derived = (("garden", "wooden"),)
    find = regex.compile(r"\b\L<t>\b", t=[t for row in (*toxicity.IDENTITY, *derived) for t in row])
    (a, b), (c, d) = toxicity._swaps("A Garden is here. Nothing else", toxicity.IDENTITY, find, derived)
    assert (a, b) == ("a garden is here", "a wooden is here") and any({c[2:-8], d[2:-8]} <= set(row) for row in toxicity.IDENTITY) and c != d


def test_the_penalty_acts_on_the_test_tables(spark, small):
    """Whatever the tables hold, sentences are swapped, and the weights follow."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    fair, free = toxicity.fit(docs, labels), toxicity.fit(docs, labels, fair=0.0)
    assert fair.pairs == free.pairs > 100
    assert (fair.buckets == free.buckets).all() and np.abs(fair.weights - free.weights).max() > 1e-3


def _plain_features(text):
    """Grams of one text by a plain loop: (bucket of a gram, how often it comes)."""
    own = np.frombuffer(f" {(text or '').lower()} ".encode(), np.uint8).copy()
    own[own < 48] = 32
    times = {}
    for n in toxicity.SIZES:
        for i in range(len(own) - n + 1):
            v = int.from_bytes(own[i : i + n].tobytes(), "little")
            h = (v * 0x9E3779B97F4A7C15 + n * 0xC2B2AE3D27D4EB4F) % 2**64
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> (64 - toxicity.BITS)
            times[h] = times.get(h, 0) + 1
    return {h + (level << toxicity.BITS) for h, n in times.items() for level, d in enumerate((None, *toxicity.DENSITY)) if d is None or n * d >= len(own)}


def test_features_and_scores_against_plain_loops(spark, small):
    import pyarrow as pa

    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = [r["text"] for r in docs.limit(12).collect()] + [None, "", "idiot", "x" * 300_000 + " idiot"]
    doc, f = toxicity._present(pa.array(texts, pa.string()))
    want = [_plain_features(x) for x in texts]
    assert [set(f[doc == i].tolist()) for i in range(len(texts))] == want and len(f) == sum(map(len, want))
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    at = {b: w for b, w in zip(model.buckets.tolist(), model.weights.tolist(), strict=True)}
    plain = [1 / (1 + np.exp(-(model.bias + sum(at.get(x, 0.0) for x in own)))) for own in want]
    assert np.allclose(model.scores(pa.array(texts, pa.string()), model.lookup()), plain)


def test_counts_by_strips_are_those_of_plain_loops(spark):
    docs, labels = corpus(40)
    rows = spark.createDataFrame([(x, y) for (_, x), (_, y) in zip(docs, labels, strict=True)] + [(None, 0), ("", 1)], "text string, toxic int").repartition(3)
    want = {}
    for r in rows.collect():
        for f in _plain_features(r["text"]):
            want.setdefault(f, [0, 0])[r["toxic"]] += 1
    got = {r["bucket"]: [r["n0"], r["n1"]] for r in toxicity._totals(rows).collect()}
    assert got == {f: n for f, n in want.items() if sum(n) >= toxicity.LEAST} and len(got) > 100
    n = np.random.default_rng(3).integers(0, 2**31, (2, toxicity.STRIP)).astype(np.int32)
    assert (toxicity._spread(toxicity._squeezed(n)) == n).all()


def test_labelled_rows_get_through_the_bitmap(spark, monkeypatch):
    ids = [(i * 7919, "x") for i in range(-2000, 2000)] + [(None, "x"), (7919, "y")]
    text, own = spark.createDataFrame(ids, "doc_id long, text string"), spark.createDataFrame([(i * 7919,) for i in range(-300, 300)] * 2, "doc_id long")
    labelled = text.join(own.distinct(), "doc_id", "left_semi")
    for most in (1 << 28, 100, 1):
        monkeypatch.setattr(toxicity, "MOST_MARKS", most)
        got = toxicity._likely(text, own)
        assert got.columns == text.columns and labelled.exceptAll(got).count() == 0 and labelled.count() == 601
        assert most < 1 << 28 or got.count() < 1000
    assert toxicity._likely(text, own.selectExpr("cast(doc_id as string)")).count() == len(ids)
    assert toxicity._likely(text, own.limit(0)).count() == 0


def test_texts_without_a_label_and_single_counts_are_not_shuffled(spark, table):
    rng = random.Random(4)
    docs = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJ      ", k=10_000)) + (" vermin." if i % 40 else " garden.")) for i in range(400)]
    labels = label_table(spark, [(i, int(i % 40 > 0)) for i in range(0, 400, 20)])
    store = spark.sparkContext._jsc.sc()

    def shuffled():
        store.listenerBus().waitUntilEmpty()
        return store.statusStore().executorList(False).apply(0).totalShuffleWrite()

    whole, labels, kept = table(docs, clash=False).localCheckpoint(), labels.localCheckpoint(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        toxicity.fit(whole, labels)
        assert 0 < shuffled() - before < 2_000_000  # of 4,000,000 bytes of text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_penalty_shrinks_the_change():
    edges, feature, y = np.array([0, 2, 3, 5, 6]), np.array([0, 1, 2, 0, 1, 2]), np.array([1.0, 0, 1, 0])
    pairs = np.array([0, 2]), np.array([1, 2]), np.array([1.0, -1.0])
    free, _ = toxicity.fit_features(edges, feature, y, 3, *pairs, fair=0.0)
    held, _ = toxicity.fit_features(edges, feature, y, 3, *pairs, fair=50.0)
    assert abs(held[1] - held[2]) <= abs(free[1] - free[2]) + 1e-9


def test_products_in_strips(monkeypatch):
    gen = np.random.default_rng(2)
    x = gen.integers(0, 2, (30, 12))
    edges, feature, w = np.append(0, np.cumsum(x.sum(axis=1))), np.nonzero(x)[1], gen.standard_normal(12)
    monkeypatch.setattr(toxicity._strips, "__defaults__", (17,))
    assert len(list(toxicity._strips(edges))) > 5
    assert np.allclose(toxicity._products(edges, feature, w, 12, lambda lo, v: v**2 + lo * 0), x.T @ (x @ w) ** 2)


def test_nulls_blanks_ties_and_no_labels(spark, table, corpus):
    docs = corpus
    labels = [(i, 1) for i in (1, 3, 3, 5)] + [(3, 0), (7, 0), (9, 0), (None, 1), (8, None), (80, 0), (4000, 1)]
    for given in (labels, [(1, 1)], [(1, 0)], []):
        model = toxicity.fit(table(docs), label_table(spark, given))
        out = toxicity.score(table(docs), model)
        rows = out.collect()
        assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows) and "kept" in out.columns and out.columns.count("score") == 1
        same = {r["score"] for r in rows if r["text"] == docs[3][1]}
        assert len(same) == 1 and len({r["score"] for r in rows if not r["text"]}) == 1
    assert toxicity.score(table([]), model).collect() == []
    assert toxicity.fit(table([]), label_table(spark, labels)).bias < 0.1


def test_a_fit_in_tasks_is_the_fit_in_one_process(spark, table, monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 20)
    docs, labels = corpus(300)
    for fair in (1.0, 0.0):
        one = toxicity.fit(table(docs), label_table(spark, labels), fair=fair)
        with monkeypatch.context() as m:
            m.setattr(toxicity, "LOCAL", 100)
            m.setattr(toxicity, "WORDS", 10)
            m.delattr(toxicity, "fit_features")
            many = toxicity.fit(table(docs, parts=5), label_table(spark, labels[::-1]), fair=fair)
        assert one.pairs == many.pairs > 0 and (one.buckets == many.buckets).all()
        assert np.allclose(one.weights, many.weights) and np.isclose(one.bias, many.bias) and np.abs(one.weights).max() > 0.1


def test_the_sample_has_its_bound(spark, table):
    docs, labels = corpus(200)
    few = toxicity.fit(table(docs), label_table(spark, labels), sample=50)
    again = toxicity.fit(table(docs, parts=1), label_table(spark, labels[::-1]), sample=50)
    assert (few.buckets == again.buckets).all() and np.allclose(few.weights, again.weights)


@pytest.mark.parametrize("name", ["op1_toxicity"])
def test_query(spark, small, name):
    df = queries.queries()[name](spark, small)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    import zlib

    for r in df.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3)
