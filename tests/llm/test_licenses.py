import inspect
import random

import pytest
import regex

from strata.llm import licenses, queries

from .conftest import words


def shingles(text):
    w = regex.findall(r"[^ \t-\r]+", (text or "").lower().translate({ord(c): " " for c in licenses._SIGNS}))
    w = [x for x in (x.rstrip(".") for x in w) if x]  # a full stop ends a sentence, not a word
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows, notices):
    out = []
    for i, text in rows:
        s = shingles(text)
        for name, notice in notices.items():
            own = set(shingles(notice))
            m = len(own)
            step = max(2, m // 4)
            share = {q: len(own & set(s[q : q + m + step - 1])) / m for q in range(0, len(s), step)}
            good = {q: x for q, x in share.items() if x >= 0.8}
            if good:
                out.append((str(i), name, max(good.values()), min(good), len(good)))
    return sorted(out)


@pytest.fixture
def noticed():
    rng = random.Random(7)
    rows = []
    for i in range(60):
        text = words(rng, rng.randrange(0, 60))
        for n in rng.sample(list(licenses.NOTICES.values()), rng.randrange(3)):
            w = n.split()
            if i % 4 == 1:
                w[rng.randrange(len(w))] = "other"
            text += ["\n", " ", "\n\n\t"][i % 3] + " ".join(w[: len(w) - (i % 5 == 2)]).upper() + words(rng, rng.randrange(0, 60))
        rows.append((i, text))
    long = words(rng, 2000)
    return [*rows, (100, f"{long} {licenses.NOTICES['MIT-grant']} {long}"), (101, None), (102, ""), (103, "MIT"), (104, "Released under the MIT License." * 3), (104, "Released under the MIT License."), (None, "\n Released under, the (MIT) License.")]


def test_against_brute_force(table, noticed):
    got = licenses.find_notices(table(noticed))
    rows = [tuple(r) for r in got.collect()]
    want = {}
    for i, n, c, f, k in brute(noticed, licenses.NOTICES):  # rows of one doc_id are one answer
        a = want.setdefault((i, n), [0, 1 << 60, 0])
        want[i, n] = [max(a[0], c), min(a[1], f), a[2] + k]
    assert {(str(i), n): (round(c, 9), f) for i, n, c, f, _ in rows} == {k: (round(v[0], 9), v[1]) for k, v in want.items()}
    assert sum(i == 100 for i, *_ in rows) == 1 and any(i is None for i, *_ in rows)


def test_other_notices_and_no_rows(table):
    own = {"short": "just five words in here", "long": " ".join(f"term{i}" for i in range(300))}
    rows = [(1, "x " * 50 + own["long"] + " y"), (2, "say just five words in here now"), (3, "just five words in there")]
    assert sorted((r["doc_id"], r["license"]) for r in licenses.find_notices(table(rows), own).collect()) == [(1, "long"), (2, "short")]
    assert licenses.find_notices(table([])).collect() == []
    with pytest.raises(ValueError):
        licenses.find_notices(table([]), {})


def test_notices_within_sentences_and_too_short_ones(table):
    rows = [(1, 'x Licensed under the Apache License, Version 2.0 (the "License") y'), (2, "Released under the MIT License, see there."), (3, "Licensed under CC BY-NC 4.0 by us . . ."), (4, "Released under the BSD License.")]
    assert {(r["doc_id"], r["license"]) for r in licenses.find_notices(table(rows)).collect()} == {(1, "Apache-2.0"), (2, "MIT"), (3, "CC-BY-NC-4.0")}
    with pytest.raises(ValueError, match="fewer than 5"):
        licenses.find_notices(table(rows), {"a": "one two three four", "b": "a b c d e"})


def test_native():
    assert not any(x in inspect.getsource(licenses) for x in ("udf", "InPandas", "InArrow", ".rdd", "import pandas", "pyarrow"))


def test_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted((str(r["doc_id"]), r["license"], r["containment"], r["first_word"], r["windows"]) for r in queries.op5_licenses(spark, small).collect())
    assert got == brute(docs, licenses.NOTICES)
