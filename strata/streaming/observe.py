"""Observation of a store: what a reader sees now, then again after every change.

The stream's source is the folder of version files, one small file for each
write, so nothing is seen before it is published and a checkpoint keeps the place.
The first value is read at version v; versions after v follow in order, so no
change falls in between. Delivery is at least once after a restart.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.operators.collection import Collection
from strata.sources.log import Segment, Store, newest


def versions(store: Store) -> DataFrame:
    """Streaming (text): each published version's file."""
    return store.spark.readStream.option("maxFilesPerTrigger", 1000).text(store.versions_path, wholetext=True).withColumnRenamed("value", "text")


def _watch(store: Store, entity: str, after: int, changed: Callable[[int, list[Segment]], None], checkpoint: str, trigger: dict[str, Any]) -> StreamingQuery:
    def batch(rows: DataFrame, _: int) -> None:
        said = sorted((json.loads(r["text"]) for r in rows.collect()), key=lambda v: v["version"])  # version files of one trigger, 1,000 at most
        for v in said:
            own = [Segment(**s) for s in v["wrote"] if s["entity"] == entity]
            if v["version"] > after and own:
                changed(v["version"], own)

    return versions(store).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def observe_by_id(coll: Collection, id: str, emit: Callable[[Row | None], None], checkpoint: str, **trigger: Any) -> StreamingQuery:
    """emit the document now, and again after each write that names it; None where it isn't there. trigger: as in writeStream."""
    store, v = coll.log.store, coll.log.store.version()

    def at(version: int) -> Row | None:
        return coll.df(version).where(F.col("id") == id).first()

    def changed(version: int, wrote: list[Segment]) -> None:
        if not coll.log._scan(wrote).where(F.col("id") == id).isEmpty():
            emit(at(version))

    if v == 0:
        _first_version(store)
        v = store.version()
    emit(at(v))
    return _watch(store, coll.log.entity, v, changed, checkpoint, trigger or {"processingTime": "1 second"})


def observe_all(coll: Collection, emit: Callable[[DataFrame], None], checkpoint: str, **trigger: Any) -> StreamingQuery:
    """emit all documents as a table now, and again after every write to the collection."""
    store, v = coll.log.store, coll.log.store.version()
    if v == 0:
        _first_version(store)
        v = store.version()
    emit(coll.df(v))
    return _watch(store, coll.log.entity, v, lambda version, _: emit(coll.df(version)), checkpoint, trigger or {"processingTime": "1 second"})


def _first_version(store: Store) -> None:
    """A stream needs its folder to be there."""
    store.publish([])


def latest_stream(mutations: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key of a streaming table of mutations; for output mode update or complete."""
    return newest(mutations, keys, F.col(order))
