"""Session defaults for local runs; a cluster's own settings always win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
}


def local_session(cores: int | str | None = None, app: str = "codequery") -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=LOCAL_CONF).getOrCreate()
