"""A corpus cleaned and packed in five stages, each on all that the one before kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontaminate, nearcopies, packing, substrings, toxicity
from strata.llm.queries import tokenizer_path
from strata.llm.runtime import prepare, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows that a Parquet reader has at once: arrays of thousands of long texts are large pieces of an executor's heap.
READ_ROWS = 512


def small_reads(stage):
    """stage, in a session that reads READ_ROWS at once."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@small_reads
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; the classifier learns from the labels of these documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


@small_reads
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or near texts, the document with the smallest doc_id."""
    return nearcopies.keep_one(docs.select(*COLUMNS))


@small_reads
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the word windows that a document with a smaller doc_id has; unchanged where there are none."""
    done = substrings.remove_repeats(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    return done.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


@small_reads
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.select(*COLUMNS).join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


@small_reads
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its training sequence."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("benchmark", drop_leaks),
    ("packing", pack),
]
#: No stage can be put in SQL as a whole; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir; what each stage returns is written to the shared folder and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
