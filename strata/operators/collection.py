"""Typed document collections.

The schema is the reader's: columns that the stored rows don't have take their
default, stored columns that it doesn't name aren't read. Documents are native
columns, so filters and projections reach the scan. Each row says which fields it
was written with (one value a batch, dictionary-encoded), so that an explicit
null and a field that didn't exist yet stay apart. With a codec a document is one
text column instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.serde import Codec, filled
from strata.sources.log import Log, Segment, Store

FIELDS = "_fields"


class Collection:
    """Documents by their string id. schema: the document's fields; id is the key whether or not schema has it."""

    def __init__(self, store: Store, name: str, schema: T.StructType | str, defaults: Mapping[str, Any] | None = None, required: Sequence[str] = (), codec: Codec | None = None):
        full = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.name, self.codec, self.defaults, self.required = name, codec, dict(defaults or {}), list(required)
        self.schema = T.StructType([f for f in full.fields if f.name != "id"])
        own = [T.StructField("value", T.StringType())] if codec else [*self.schema.fields, T.StructField(FIELDS, T.StringType())]
        self.log = Log(store, f"doc-{name}", T.StructType([T.StructField("id", T.StringType()), *own]), ["id"])
        self.spark, self.indexes = store.spark, {}

    # writing

    def _rows(self, docs: DataFrame | Iterable[Mapping[str, Any]]) -> tuple[DataFrame, Column | None]:
        if isinstance(docs, DataFrame):
            return docs, None
        known = [T.StructField("id", T.StringType()), *self.schema.fields]
        docs = list(docs)
        said = [f for f in known if f.name == "id" or any(f.name in d for d in docs)]
        rows = [(*[d.get(f.name) for f in said], i) for i, d in enumerate(docs)]
        return self.spark.createDataFrame(rows, T.StructType([*[T.StructField(f.name, f.dataType) for f in said], T.StructField("_at", T.LongType())])), F.col("_at")

    def stage(self, docs: DataFrame | Iterable[Mapping[str, Any]], order: Column | None = None) -> Segment:
        rows, own = self._rows(docs)
        names = [f.name for f in self.schema.fields if f.name in rows.columns]
        if self.codec:
            typed = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
            rows = rows.withColumn("value", self.codec.encode(F.struct(F.col("id"), *typed)))
        else:
            rows = rows.withColumn(FIELDS, F.lit(",".join(names)))
        return self.log.stage(rows, order=order if order is not None else own)

    def insert_batch(self, docs: DataFrame | Iterable[Mapping[str, Any]], order: Column | None = None) -> int:
        """Put all documents at once; one that is there is replaced whole."""
        return self.log.store.publish([self.stage(docs, order)])

    def insert(self, id: str, **fields: Any) -> int:
        return self.insert_batch([{"id": id, **fields}])

    def insert_json(self, texts: DataFrame, column: str = "json") -> int:
        """Put documents from (id, JSON text); malformed text is an error and writes nothing."""
        from strata.functions.serde import decode_json

        doc = decode_json(F.col(column), self.schema, self.defaults, self.required)
        return self.insert_batch(texts.select("id", doc.alias("_d")).select("id", "_d.*"))

    def delete(self, *ids: str) -> int:
        """Delete documents; one that isn't there is no error."""
        return self.log.append(self.spark.createDataFrame([(i,) for i in ids], "id string"), "D")

    def delete_all(self) -> int:
        """Delete what the newest version has; nothing is written where that is nothing."""
        ids = self.ids()
        return self.log.append(ids, "D") if not ids.isEmpty() else self.log.store.version()

    # reading

    def df(self, version: int | None = None) -> DataFrame:
        """id and the fields of every live document."""
        rows = self.log.snapshot(version)
        if self.codec:
            return rows.select("id", self.codec.decode(F.col("value"), T.StructType([T.StructField("id", T.StringType()), *self.schema.fields])).alias("_d")).select("id", *[F.col("_d")[f.name].alias(f.name) for f in self.schema.fields])
        if not self.defaults and not self.required:
            return rows.select("id", *self.schema.fieldNames())
        there = F.split(F.col(FIELDS), ",")
        doc = filled(F.struct(*self.schema.fieldNames()), self.schema, lambda n: F.array_contains(there, n), self.defaults, self.required)
        return rows.select("id", doc.alias("_d")).select("id", "_d.*")

    all = df

    def get(self, id: str) -> Row | None:
        return self.df().where(F.col("id") == id).first()

    def by_id_prefix(self, prefix: str) -> DataFrame:
        return self.df().where(F.col("id").startswith(prefix))

    def ids(self) -> DataFrame:
        return self.log.snapshot().select("id")

    def ids_by_prefix(self, prefix: str, remove_prefix: bool = False) -> DataFrame:
        """Ids that start with prefix, or what follows it; documents aren't read."""
        ids = self.ids().where(F.col("id").startswith(prefix))
        return ids.select(F.expr(f"substring(id, {len(prefix) + 1})").alias("id")) if remove_prefix else ids

    def create_index(self, name: str, value: Column) -> None:
        """Name an expression over a document's fields for :meth:`by_index`."""
        self.indexes[name] = value

    def by_index(self, name: str, value: str) -> DataFrame:
        """Documents whose index value is now `value`, each once."""
        return self.df().where(self.indexes[name].cast("string") == value)

    def index_table(self, name: str) -> DataFrame:
        """(value, id) of every document, for joins by index value."""
        return self.df().select(self.indexes[name].cast("string").alias("value"), "id")

    def count(self) -> int:
        return self.ids().count()

    def compact(self) -> int:
        return self.log.compact()
