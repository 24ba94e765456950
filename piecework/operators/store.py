"""Tables written to the folder that the cluster shares, which cut the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a fresh local one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="piecework-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Written:
    """A table in the shared folder, with a way to remove it once nothing reads it."""

    def __init__(self, df: DataFrame, name: str, by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path, partitionBy=by)
        self.table = self.spark.read.schema(df.schema).parquet(self.path)

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
