"""Sessions with the settings the library is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session; on a cluster the master and sizes come from spark-submit."""
    b = SparkSession.builder.appName("recollex").config(map=SETTINGS | settings)
    return (b.master(master) if master else b).getOrCreate()
