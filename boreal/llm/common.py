"""What the training-data operators share: reading tables, stage files, words."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor reaches. Where that is unset, a temporary one, on a local master alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="boreal-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, *folders: str) -> None:
    """Delete stage folders that no later step reads."""
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive any executor."""
    folder = new_folder(df.sparkSession, tag)
    df.write.parquet(folder, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def arrow_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """What is written meanwhile goes to Python in Arrow batches of about `most` bytes: a task's JVM and its worker each hold a batch, up to twice over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def words(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8; bytes.split() splits at exactly the ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def batches(it, rows: int = 256):
    """Slices of at most `rows` rows of the Arrow batches of it, so that long texts are held a few at a time."""
    for batch in it:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def by_size(it, column: str, rows: int = 256, size: int = 4_000_000):
    """Slices of at most `rows` rows and `size` bytes of a text column, one longer text beside them at most."""
    for batch in batches(it, rows):
        block = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


class Stages:
    """The written steps of one query, each under a name, so that a step's files can go once nothing reads them."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.folders = spark, tag, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df, let its shuffle files go, and read it back. A step written twice under a name replaces the first, which must not be read again."""
        folder = new_folder(self.spark, f"{self.tag}-{name}")
        df.write.parquet(folder, compression="zstd")
        release(self.spark)
        self.drop(name)
        self.folders[name] = folder
        return self.spark.read.schema(df.schema).parquet(folder)

    def drop(self, *names: str) -> None:
        remove(self.spark, *[self.folders.pop(n) for n in names if n in self.folders])
