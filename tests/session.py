from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build(master: str = "local[8]") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName("evenkeel")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evenkeel-ckpt-"))
    return spark
