"""Files between the rounds of an iterative plan, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Rounds:
    """keep() writes a step as Parquet and reads it back, so that lineage stays short and a lost executor costs no round; the step that had the name before is deleted."""

    def __init__(self, spark: SparkSession, tag: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="boreal-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.root, self.folders = spark, f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}", {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        folder = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(folder)
        self.drop(name)
        self.folders[name] = folder
        return self.spark.read.schema(df.schema).parquet(folder)

    def drop(self, name: str) -> None:
        if name in self.folders:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folders.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
