"""Session factory used by tests, bench and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with AQE, UTC and ANSI on; extra settings win."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.driver.host": "127.0.0.1",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tracemill")
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
