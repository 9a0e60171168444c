"""Intermediate tables in the folder that all executors share.

A table written here survives the loss of any executor and cuts the lineage,
unlike a local checkpoint. The folder is `spark.checkpoint.dir`, or the
context's own checkpoint folder; only a local session that names neither (tests,
a laptop) gets a temporary folder, since executors share none of those.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that go when the driver ends.
_OWN: set[str] = set()
#: Pairs of items that a task makes, about.
TASK_PAIRS = 1 << 22
#: Drops an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="siftwork-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it back; its path is in `df.shared_path`.

    What is still there when the driver ends is deleted then.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/siftwork/{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    if folder not in _OWN:
        _file_system(spark, folder).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(folder))
        _OWN.add(folder)
    clean, was = CLEANUP, spark.conf.get(CLEANUP, None)
    spark.conf.set(clean, "true")  # the written table stands for the shuffles that made it
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(clean) if was is None else spark.conf.set(clean, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a table of `materialize` that no later plan reads."""
    path = getattr(df, "shared_path", None)
    if path:
        _file_system(df.sparkSession, path).delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(path), True)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly: a small file that costs much a row is read by few tasks otherwise."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def dealt(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of a written table with two arrays, over so many tasks that each makes about TASK_PAIRS pairs of their items."""
    rows, total = pairs.agg(F.count(F.lit(1)), F.sum(F.size(a).cast("long") * F.size(b))).first()
    least = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(max(1, min(rows, max(least, (total or 0) // TASK_PAIRS))))
