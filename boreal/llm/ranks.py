"""Places of rows in a total order, without a window that brings a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreal.llm.common import stage

#: Bits of monotonically_increasing_id() that count the rows of a partition.
LOCAL_BITS = 33


def tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def ordered(df: DataFrame, by: list[Column | str]) -> DataFrame:
    """df in ranges of `by`, each partition sorted, with part and local, the row's place in it from 0. Rows equal in `by` may lie in two ranges unless `by` ends with a row number."""
    at = F.monotonically_increasing_id()
    return df.repartitionByRange(tasks(df), *by).sortWithinPartitions(*by).withColumns({"part": F.shiftright(at, LOCAL_BITS), "local": at.bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))})


def ranked(df: DataFrame, by: list[Column | str], tag: str) -> DataFrame:
    """df, written once, with rank, the row's place in the order of `by` from 0. Rows equal in `by` follow each other in any order."""
    placed = stage(ordered(df.withColumn("row", F.monotonically_increasing_id()), [*by, "row"]).drop("row"), tag)
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each partition
    before, rows = 0, []
    for r in sorted(counts):
        rows.append((r.part, before))
        before += r.n
    offsets = placed.sparkSession.createDataFrame(rows, "part long, before long")
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("local")).drop("part", "local", "before")
