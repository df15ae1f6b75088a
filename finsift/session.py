"""Session construction for stand-alone runs (tests, bench); a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "finsift") -> SparkSession:
    """A local session with the settings the engine is tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FINSIFT_DRIVER_MEMORY", "8g"))
        .config("spark.checkpoint.dir", os.environ.get("FINSIFT_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="finsift-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
