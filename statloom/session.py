"""Session defaults for running the library outside a managed cluster."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "statloom", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    n = cores or os.cpu_count() or 1
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
