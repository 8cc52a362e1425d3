"""What every operator of this subpackage needs from the session."""

from __future__ import annotations

import ctypes
import functools
import io
import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch that goes to Python.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once for a context."""
    sc = spark.sparkContext
    if getattr(sc, "_strata_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    path = os.path.join(tempfile.mkdtemp(), f"strata-{uuid.uuid4().hex[:8]}.zip")
    Path(path).write_bytes(out.getvalue())
    sc.addPyFile(path)  # the driver's file server hands it out
    sc._strata_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package, bound the Arrow batches and see that a checkpoint folder is set."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    shared(spark)
    return spark


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, as in tests, one of our own, which a local master alone can have."""
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and jsc.getCheckpointDir().isEmpty() and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if jsc.getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strata-checkpoint-"))
    return named or jsc.getCheckpointDir().get()


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared(spark).rstrip('/')}/strata-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks_for(df: DataFrame, size, target_bytes: int) -> int:
    """So many chunks that each holds about target_bytes of the column expression size; one small aggregate."""
    total = df.select(F.sum(size.cast("double")).alias("b")).first()["b"] or 0.0
    return max(1, math.ceil(total / target_bytes))


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names stay out."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of names that df doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: What modules keep in a Python worker from task to task, and how to drop it.
CACHES: dict[str, Callable[[], None]] = {}


def release(keep: str = "") -> None:
    """Drop all caches but one, and give free memory back to the system: a Python worker lives on after its task, and allocators keep what is freed."""
    for name, drop in CACHES.items():
        if name != keep:
            drop()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def after(result: pa.Table) -> pa.Table:
    """What a group's function returns, once memory is released."""
    release()
    return result


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which releases memory when its task begins and ends. keep: the cache that it uses."""

    @functools.wraps(run)
    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep)
        try:
            yield from run(batches)
        finally:
            release(keep)

    return lean_run
