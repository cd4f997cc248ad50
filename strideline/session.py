"""Session defaults shared by tests, benches and the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "strideline", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings every query here assumes: UTC, ANSI, AQE on.

    On a cluster build the session as usual; only the UTC zone matters for results.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
