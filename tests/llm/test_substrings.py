import hashlib

import pytest
import regex

from strata.llm import queries, substrings


def brute(rows, k):
    own = [(i, regex.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in own:
        if i is not None:
            for a in range(len(w) - k + 1):
                s = tuple(w[a : a + k])
                first[s] = min(first.get(s, i), i)
    out = []
    for i, w in own:
        gone = set()
        if i is not None:
            for a in range(len(w) - k + 1):
                if first[tuple(w[a : a + k])] < i:
                    gone |= set(range(a, a + k))
        out.append((str(i), len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("k", "size"), [(13, 6 << 20), (13, 2000), (4, 3000), (2, 1500)])
def test_against_brute_force(table, corpus, monkeypatch, k, size):
    monkeypatch.setattr(substrings, "PART_BYTES", size)
    got = substrings.remove_repeats(table(corpus), k)
    assert {"score", "shard"} < set(got.columns)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()) == brute(corpus, k)


def test_many_copies_in_many_parts(table, monkeypatch):
    monkeypatch.setattr(substrings, "PART_BYTES", 1000)
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, text) for i in range(60)] + [(100, "a " * 40), (101, "a " * 30)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(table(rows)).collect())
    assert got == brute(rows, 13)


def test_no_rows_and_no_long_texts(table):
    assert substrings.remove_repeats(table([])).collect() == []
    assert [r["kept"] for r in substrings.remove_repeats(table([(1, "a  b")])).collect()] == ["a b"]


def test_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows, 13)]
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op4_substrings(spark, small).collect()) == want
