"""The versioned mutation log that everything is stored in.

A store is a folder: `versions/` has one small JSON file for each version, the
list of segments of every entity; `segments/` has Parquet folders. A write adds
a segment and then publishes the next version; readers see all of a version or
nothing of it, and an entity's segments of one write become visible together
with those of the other entities in it. A version file is claimed by a rename
that can't overwrite, so of two writers one tries again with the next number.
Object stores without such a rename need a committer that has one.

Rows of a segment have the entity's key and payload columns, `_batch` (claimed
before writing, so rising), `_ord` (place within the batch) and `_op`, 'P' or 'D'.
The newest (_batch, _ord) of a key wins, a newest 'D' hides it.

A compacted segment is a *base*: one row a key, no deletes, sorted. Reading base
and deltas takes the newest of the deltas only and an anti join of their keys,
so that a small delta is broadcast and a large base isn't shuffled. A batch that
is published after a compaction counts as later than what that merged.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.files import Folder

META = T.StructType().add("_batch", "long").add("_ord", "long").add("_op", "string")
TRIES, TICKETS = 100, 64
#: Segments of one entity that are merged.
COMPACT_AT = 16


@dataclass(frozen=True)
class Segment:
    entity: str
    path: str
    batch: int
    base: bool = False


class Store:
    """Versions and segments under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._versions, self._tickets = Folder(spark, f"{self.path}/versions"), Folder(spark, f"{self.path}/tickets")

    @property
    def versions_path(self) -> str:
        return f"{self.path}/versions"

    def version(self) -> int:
        """The newest version; 0 where nothing was written."""
        names = [n for n in self._versions.names() if n.endswith(".json") and not n.startswith(".")]
        return int(names[-1].removesuffix(".json")) if names else 0

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        return json.loads(self._versions.read(f"{v:020d}.json")) if v else {"version": 0, "segments": [], "wrote": []}

    def segments(self, entity: str, version: int | None = None) -> list[Segment]:
        return [Segment(**s) for s in self.manifest(version)["segments"] if s["entity"] == entity]

    def ticket(self) -> int:
        """A number larger than every earlier one; batches are ordered by it."""
        for _ in range(TRIES):
            names = [n for n in self._tickets.names() if not n.startswith(".")]
            n = int(names[-1]) + 1 if names else 1
            if not self._tickets.claim(f"{n:020d}", ""):
                continue
            # a number that was given out and deleted meanwhile is at least TICKETS behind the newest
            if int([x for x in self._tickets.names() if not x.startswith(".")][-1]) - n < TICKETS:
                for old in names[:-TICKETS]:
                    self._tickets.delete(old)
                return n
        raise RuntimeError("too many writers at once")

    def publish(self, add: Sequence[Segment], drop: Sequence[Segment] = ()) -> int:
        """The version that has `add` and no longer `drop`. RuntimeError where another writer has taken `drop` away meanwhile."""
        gone = {s.path for s in drop}
        for _ in range(TRIES):
            now = self.manifest()
            if not gone <= {s["path"] for s in now["segments"]}:
                raise RuntimeError("the segments to replace have changed")
            kept = [s for s in now["segments"] if s["path"] not in gone]
            v = now["version"] + 1
            said = {"version": v, "segments": kept + [s.__dict__ for s in add], "wrote": [s.__dict__ for s in add if not s.base]}
            if self._versions.claim(f"{v:020d}.json", json.dumps(said)):
                return v
        raise RuntimeError("too many writers at once")

    def new_path(self, entity: str) -> str:
        return f"{self.path}/segments/{entity}/{uuid.uuid4().hex}"

    def clean(self) -> None:
        """Delete older versions and what the newest doesn't name. Only while nobody writes or reads an older version."""
        newest_ = self.version()
        named = {s["path"] for s in self.manifest(newest_)["segments"]}
        for name in self._versions.names():
            if name < f"{newest_:020d}.json":
                self._versions.delete(name)
        top = Folder(self.spark, f"{self.path}/segments")
        for entity in top.names():
            for name in Folder(self.spark, f"{top.path}/{entity}").names():
                if f"{top.path}/{entity}/{name}" not in named:
                    top.delete(f"{entity}/{name}")

    def drop_all(self) -> None:
        Folder(self.spark, self.path).delete()


def newest(rows: DataFrame, keys: Sequence[str], order: Column, live: Column | None = None) -> DataFrame:
    """Of each key the row that is last by order, if it is live. A filter on keys reaches the scan through the aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    out = best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
    return out if live is None else out.where(live)


class Log:
    """One entity's rows: key columns, and payload columns that may be null."""

    def __init__(self, store: Store, entity: str, schema: T.StructType, keys: Sequence[str]):
        self.store, self.entity, self.schema, self.keys = store, entity, schema, list(keys)
        self.spark = store.spark
        self.payload = [f.name for f in schema.fields if f.name not in self.keys]
        self.stored = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema.fields], *META.fields])

    # writing

    def _fitted(self, rows: DataFrame, op: str, batch: int, order: Column | None) -> DataFrame:
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        at = F.monotonically_increasing_id() if order is None else order.cast("long")
        return rows.select(*cols, F.lit(batch).cast("long").alias("_batch"), at.alias("_ord"), (F.col("_op") if "_op" in rows.columns else F.lit(op)).alias("_op"))

    def stage(self, rows: DataFrame, op: str = "P", order: Column | None = None, batch: int | None = None) -> Segment:
        """Write a segment without publishing it. A row whose key has a null is an error; a column _op overrides op."""
        batch = self.store.ticket() if batch is None else batch
        fit = self._fitted(rows, op, batch, order)
        bad = F.lit(False)
        for k in self.keys:
            bad = bad | F.col(k).isNull()
        k = self.keys[0]
        fit = fit.withColumn(k, F.when(bad, F.raise_error(F.lit(f"{self.entity}: null key")).cast(self.schema[k].dataType)).otherwise(F.col(k)))
        path = self.store.new_path(self.entity)
        self._write(fit.sortWithinPartitions(*self.keys), path)
        return Segment(self.entity, path, batch)

    def _write(self, rows: DataFrame, path: str) -> None:
        w = rows.write
        for k in self.keys:
            w = w.option(f"parquet.bloom.filter.enabled#{k}", "true")
        w.parquet(path)

    def append(self, rows: DataFrame, op: str = "P", order: Column | None = None) -> int:
        """Publish a batch: op 'P' puts rows, 'D' deletes keys. Of rows with one key the last by order wins.

        A batch that makes COMPACT_AT segments is followed by a compaction, so reads don't slow down with every write.
        """
        version = self.store.publish([self.stage(rows, op, order)])
        if len(self.store.segments(self.entity, version)) >= COMPACT_AT:
            self.compact()
        return version

    # reading

    def _scan(self, segments: Sequence[Segment]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*[s.path for s in segments])

    def mutations(self, version: int | None = None) -> DataFrame:
        """All rows, old and new, with _batch, _ord and _op."""
        return self._scan(self.store.segments(self.entity, version))

    def _newest(self, rows: DataFrame) -> DataFrame:
        return newest(rows, self.keys, F.struct("_batch", "_ord"))

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The live rows of a version: key and payload columns."""
        segments = self.store.segments(self.entity, version)
        base, deltas = [s for s in segments if s.base], [s for s in segments if not s.base]
        names = self.schema.fieldNames()
        old = self._scan(base).select(*names)
        if base and not deltas:
            return old
        late = self._newest(self._scan(deltas))
        live = late.where(F.col("_op") == "P").select(*names)
        if not base:
            return live
        changed = self._scan(deltas).select(*self.keys).distinct()
        return old.join(changed, self.keys, "left_anti").select(*names).unionByName(live)

    def compact(self) -> int:
        """Merge all segments into one base, sorted by key over the whole segment. Writers may go on meanwhile."""
        version = self.store.version()
        segments = self.store.segments(self.entity, version)
        if not segments or (len(segments) == 1 and segments[0].base):
            return version
        live = self.snapshot(version).select("*", F.lit(0).cast("long").alias("_batch"), F.lit(0).cast("long").alias("_ord"), F.lit("P").alias("_op"))
        path = self.store.new_path(self.entity)
        self._write(live.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys), path)
        return self.store.publish([Segment(self.entity, path, max(s.batch for s in segments), True)], segments)
