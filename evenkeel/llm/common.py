"""What the operators share: reading, shared storage, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in `spark.checkpoint.dir`, which driver and executors
    share. A local session without one gets a folder of its own; a cluster must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="evenkeel-shared-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder, so that a lost executor costs no recomputation of what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet to the shared folder and read that: a columnar cut, for wider rows."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a variant of it that no column of `df` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows in a landed table with a number each, and the name of the column that holds it."""
    number = free_name(docs, "row")
    return landed(docs.withColumn(number, F.monotonically_increasing_id()), "numbered"), number


def col(name: str) -> Column:
    """A top-level column, also where its name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, under names that cannot clash; null texts become empty."""
    return df.select(col(key).alias("id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))


def dropped(df: DataFrame) -> None:
    """Delete a table that `landed` has written, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    own = path(shared_folder(spark)).toUri().getPath()
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        place = path(folder)
        if not place.toUri().getPath().startswith(own):
            raise ValueError(f"not a landed table: {folder}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
