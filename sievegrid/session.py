"""A session with the settings this library is tested with; on a cluster use the cluster's own."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """On one machine, whose temporary folder driver and executors share."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="sievegrid-"),
    }
    return SparkSession.builder.master(f"local[{cpus}]").appName("sievegrid").config(map=settings).getOrCreate()
