"""A Spark session with the settings that this package is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "strata", **settings: str) -> SparkSession:
    """The running session, or a new one. On a cluster leave master to spark-submit."""
    b = SparkSession.builder.appName(app).config(map=SETTINGS | settings)
    return (b.master(master) if master else b).getOrCreate()
