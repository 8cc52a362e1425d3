"""Vector arithmetic as Columns. Sums are in double; an array that is null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The cosine of two vectors that can't be compared, and the least score that counts as a result.
MISMATCH, LEAST = -2.0, -1.5


def magnitude(v: Column) -> Column:
    """Length of a vector; 0 for an empty one."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where the dimensions differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity: 0 where a vector is zero, MISMATCH where the dimensions differ."""
    length = magnitude(a) * magnitude(b)
    return F.when(F.size(a) != F.size(b), F.lit(MISMATCH)).when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def counts(score: Column) -> Column:
    """Whether a score is a result: not a mismatch and not NaN (which Spark holds to be larger than any number)."""
    return (score > LEAST) & ~F.isnan(score)
