"""Session defaults. A cluster's own settings always win; these only fill gaps for local work."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", memory: str = "8g", app: str = "quarry") -> SparkSession:
    """A local session with UTC time, adaptive execution and few shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
