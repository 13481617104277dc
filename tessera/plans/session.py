"""Session for local runs; on a cluster the operators use whatever session they are given."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: str | int | None = None, name: str = "tessera") -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(name)
             .config("spark.sql.shuffle.partitions", str(cores))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
