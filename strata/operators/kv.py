"""Byte keys and values: gets, prefix scans and ordered scans over a log's snapshot.

An empty value is a delete. Keys are compared as unsigned bytes, shorter first,
which is Spark's order of binary.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.log import Log, Store, newest

SCHEMA = T.StructType().add("key", "binary").add("value", "binary")


def live(rows: DataFrame, order: Column) -> DataFrame:
    """(key, value) of a table of puts: the last of each key, without those whose last value is null or empty."""
    return newest(rows, ["key"], order, F.coalesce(F.octet_length("value"), F.lit(0)) > 0).select("key", "value")


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all that start with prefix; None where there is none."""
    p = prefix.rstrip(b"\xff")
    return p[:-1] + bytes([p[-1] + 1]) if p else None


def has_prefix(key: Column, prefix: bytes) -> Column:
    """A range on key, which Parquet's statistics can skip by."""
    end = prefix_end(prefix)
    from_ = key >= F.lit(prefix)
    return from_ & (key < F.lit(end)) if end is not None else from_


class KeyValues:
    """The pairs of a store."""

    def __init__(self, store: Store, entity: str = "kv"):
        self.log = Log(store, entity, SCHEMA, ["key"])
        self.spark = store.spark

    def write_batch(self, pairs: Iterable[tuple[bytes, bytes]]) -> int:
        """All pairs at once; of pairs with one key the later wins."""
        rows = [(k, v, i) for i, (k, v) in enumerate(pairs)]
        return self.write(self.spark.createDataFrame([(bytearray(k), bytearray(v), i) for k, v, i in rows], "key binary, value binary, at long"), F.col("at"))

    def write(self, rows: DataFrame, order: Column | None = None) -> int:
        """A table of pairs as one batch."""
        empty = F.coalesce(F.octet_length("value"), F.lit(0)) == 0
        return self.log.append(rows.withColumn("_op", F.when(empty, "D").otherwise("P")), order=order)

    def put(self, key: bytes, value: bytes) -> int:
        return self.write_batch([(key, value)])

    def delete(self, key: bytes) -> int:
        return self.write_batch([(key, b"")])

    def df(self, version: int | None = None) -> DataFrame:
        return self.log.snapshot(version)

    def get(self, key: bytes) -> bytes | None:
        row = self.df().where(F.col("key") == F.lit(key)).first()
        return None if row is None else bytes(row["value"])

    def get_string(self, key: str) -> str | None:
        v = self.get(key.encode())
        return None if v is None else v.decode()

    def by_prefix(self, prefix: bytes) -> DataFrame:
        """(key, value) of the keys that start with prefix."""
        return self.df().where(has_prefix(F.col("key"), prefix))

    def keys_by_prefix(self, prefix: bytes) -> DataFrame:
        return self.by_prefix(prefix).select("key")

    def tail(self, key: bytes) -> DataFrame:
        """All pairs from key on, in order."""
        return self.df().where(F.col("key") >= F.lit(key)).orderBy("key")

    def ordered(self) -> DataFrame:
        return self.df().orderBy("key")

    def compact(self) -> int:
        return self.log.compact()
