"""Intermediate tables written once, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir.

    In local mode a temporary folder stands in where the setting is missing; a cluster needs it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{folder.rstrip('/')}/bayline-core/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to a shared path and read back, for what several plans read."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._bayline_path = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Delete tables that written() gave and that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._bayline_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
