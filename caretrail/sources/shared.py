"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, as in tests, all run on one machine, and this sets one for the session; on a
    cluster it has to be named."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-caretrail-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: cuts the lineage, is worked out once, survives lost executors.

    Results are lazy and read these tables later, so they stay until the folder's owner clears it.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows in a task that works on texts in Python.
PER_TASK = 20_000


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """rows, n of them, dealt to tasks by their number: a small file of keys makes few tasks, however long the texts are that it is
    joined with."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, n // PER_TASK + 1))
