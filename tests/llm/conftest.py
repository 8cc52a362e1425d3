import random

import pytest
from hypothesis import settings
from pyspark.sql import types as T

settings.register_profile("slow", deadline=None, max_examples=60)  # the first example may build tables
settings.load_profile("slow")
DOCS = T.StructType().add("doc_id", "long").add("text", "string")
#: Columns of other tables that must not get in the way.
CLASHES = ["score", "kept", "n_words", "n_removed", "shard", "slot", "_bucket", "_place", "_mark", "_at", "_before", "_all", "_n", "_number", "_strata_part", "fp_0", "fingerprint", "component_id", "digest", "fps", "sketch", "id", "key", "label", "toxic", "length", "piece", "window", "words", "shingles", "hits"]


@pytest.fixture
def table(spark):
    """Makes (doc_id, text) rows with clashing extra columns a table."""
    from pyspark.sql import functions as F

    def make(rows, clash=True, parts=3):
        df = spark.createDataFrame(list(rows), DOCS).repartition(parts)
        return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)]) if clash else df

    return make


def words(rng, n, vocabulary=None):
    return " ".join(rng.choice(vocabulary or ["ka", "lo", "mi", "né", "pu", "ra", "st"]) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture
def corpus():
    """Texts with copies, near copies, shared passages, nulls, blanks and one long text."""
    rng = random.Random(11)
    rows = [(i, words(rng, rng.randrange(1, 120))) for i in range(40)]
    passage = words(rng, 40)
    rows += [(40 + i, f"{words(rng, 20)} {passage}\t{words(rng, 10)}") for i in range(5)]
    long = words(rng, 3000)
    rows += [(50, long), (51, f"{long} more"), (52, rows[3][1]), (53, rows[3][1]), (54, rows[3][1].upper())]
    base = words(rng, 200).split(" ")
    for i in range(12):
        w = list(base)
        w[rng.randrange(200)] = "changed"
        rows.append((60 + i, " ".join(w)))
    rows += [(80, None), (81, ""), (82, " \n\t "), (83, "one"), (84, "One"), (85, "\x0bone\x0c"), (86, "two words"), (None, rows[3][1]), (None, None), (87, " non-breaking space"), (3, rows[3][1])]
    return rows
