"""Spark sessions with the settings that the library's results and plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC dates and Arrow transfer; AQE coalesces, splits skewed joins and switches join strategies at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", name: str = "kinmark", more: dict[str, str] | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters set their own master, memory and partitions."""
    conf = SETTINGS | {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": name,
        "spark.sql.shuffle.partitions": str(cpus if isinstance(cpus, int) else 8),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    session = SparkSession.builder.config(map=conf | (more or {})).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
