"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a new temporary one in local mode.

    A cluster needs the setting: its executors share no temporary folder with the driver.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
        folder = getattr(spark, "_bayline_shared", None)
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark._bayline_shared = folder
    return folder.rstrip("/")


#: Held while a table is written: shuffle files go as soon as the write has ended, and batches for
#: Python stay small beside what the workers make of them.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
#: One table is written at a time, since the settings are the session's.
_writing = threading.Lock()


def materialise(df: DataFrame, codec: str = "zstd", by: str | None = None, batch: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back; by names a column with a folder for each value.

    batch is the most bytes of a batch for Python, for work that needs many times its input. The
    written table cuts the lineage: a lost executor costs its running tasks only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bayline/{uuid.uuid4().hex}"
    with _writing:
        before = {key: spark.conf.get(key, None) for key in WHILE_WRITING}
        try:
            for key, value in WHILE_WRITING.items():
                spark.conf.set(key, value)
            if batch:
                spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)
            df.write.option("compression", codec).partitionBy([by] if by else []).parquet(path)
        finally:
            for key, value in before.items():
                if value is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._bayline_path = path
    return out


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete tables that materialise() wrote, or their folder part (column=value), that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{table._bayline_path}/{part}")
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
