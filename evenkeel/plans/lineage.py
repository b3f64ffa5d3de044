"""Cut the lineage of iterative jobs in storage that outlives executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`. A local session without one gets a folder of its
    own; a cluster must name a shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="evenkeel-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def landed(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write as Parquet to the shared folder and read that: far smaller than a checkpoint, without its partitions.
    With `by`, a folder for each value of that column, of which a filter reads only its own."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    # The schema is known, also of a table without rows; no job need look for it.
    return df.sparkSession.read.schema(df.schema).parquet(path)
