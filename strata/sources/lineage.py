"""Where intermediate results go: the folder that driver and executors share."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the executors' Python, once for a context."""
    sc = spark.sparkContext
    if not getattr(sc, "_strata_core_shipped", False):
        top, out = Path(__file__).resolve().parents[1], io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent).as_posix())
        path = os.path.join(tempfile.mkdtemp(), f"strata-core-{uuid.uuid4().hex[:8]}.zip")
        Path(path).write_bytes(out.getvalue())
        sc.addPyFile(path)
        sc._strata_core_shipped = True
    return spark


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a folder of our own, which a local master alone can have."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and sc._jsc.sc().getCheckpointDir().isEmpty() and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strata-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame, name: str = "step", *by: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor costs none of it. by: columns that have a folder for each value."""
    path = f"{shared(df.sparkSession).rstrip('/')}/strata-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
