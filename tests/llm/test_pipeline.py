import pytest

import corpus_pipeline as P
from strata.llm import decontaminate, queries, toxicity
from strata.llm import runtime

from .test_nearcopies import brute as near_brute
from .test_substrings import brute as window_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small):
    """Each stage's input and output."""
    runtime.prepare(spark)
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, f in P.STAGES:
        after = runtime.table(f(spark, docs, small), name)
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_shape(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_copies", "repeats", "benchmark", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == COLUMNS and after.dtypes == before.dtypes


def test_toxic_documents_go(spark, small, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{small}/labels.parquet"))
    want = {r["doc_id"] for r in toxicity.score(before, model).where("score < 0.3").collect()}
    assert set(texts(after)) == want < set(texts(before))


def test_toxicity_is_learned_from_all_labelled_rows(spark, tmp_path, monkeypatch):
    """Of more than 20,000 labelled rows, only those with the largest hashes are toxic."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(toxicity, "ROUNDS", 30)
    ids = spark.range(28_400).where(~toxicity.held_out("id")).orderBy(F.xxhash64("id"), "id").toArrow()["id"].to_pylist()
    bad = set(ids[20_000:])
    assert len(bad) > 500
    held = set(range(28_400)) - set(ids)
    texts = [(i, f"filthy wretched vermin {i}" if i in bad or i in held and i % 9 == 0 else f"the river runs past {i}") for i in range(28_400)]
    spark.createDataFrame([(i, int(i in bad)) for i in ids], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in P.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i, t in texts if "vermin" not in t}


def test_one_of_each_group_stays(stages):
    before, after = stages["near_copies"]
    own = texts(before)
    _, group = near_brute(own.items())
    kept = set(texts(after))
    assert kept <= set(own) and {i for i in own if group[i] == i} <= kept
    assert len(kept) <= 1.005 * len(set(group.values()))


def test_repeats_are_cut(stages):
    before, after = stages["repeats"]
    own, got = texts(before), texts(after)
    for i, n, gone, kept in window_brute(own.items(), 13):
        assert got[int(i)] == (kept if gone else own[int(i)])
    assert set(got) == set(own)
    assert all(r["n_chars"] == len(r["text"] or "") for r in after.collect() if r["text"] != own[r["doc_id"]])


def test_leaks_go(spark, small, stages):
    before, after = stages["benchmark"]
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(before, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert set(texts(after)) == set(texts(before)) - leaks


def test_leaks_are_searched_with_a_fit_on_all_passages(spark, small, stages, monkeypatch):
    monkeypatch.setattr(decontaminate, "SAMPLE", 10, raising=False)
    seen, latent = [], decontaminate.latent

    def spy(passages, *a):
        seen.append(sum(len(decontaminate.unpacked(b)[1]) for b in passages.toArrow().to_batches()) if "sizes" in passages.columns else passages.count())
        return latent(passages, *a)

    monkeypatch.setattr(decontaminate, "latent", spy)
    before, after = stages["benchmark"]
    assert set(texts(P.drop_leaks(spark, before, small))) == set(texts(after))
    words = decontaminate.tokens(before.select("text").toArrow()["text"])[0].counts
    assert seen == [(-(-words // decontaminate.LONGEST)).sum()]


def test_all_that_is_left_is_packed(stages):
    before, after = stages["packing"]
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == set(texts(before))
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in fill.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096


def test_query_is_the_stages(spark, small, stages):
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(queries.pipeline(spark, small)) == key(stages["packing"][1])


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_stages_take_strange_rows(spark, small, table, corpus, stage):
    from pyspark.sql import functions as F

    docs = table(corpus).select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    got = stage(spark, docs, small)
    assert got.count() > 0 and stage(spark, docs.limit(0), small).count() == 0
