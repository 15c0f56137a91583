"""Ranks over a whole table without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.session import scratch


def ranked(df: DataFrame, keys: list, name: str, function: Column | None = None) -> DataFrame:
    """df with its global row number (or F.rank()) by ``keys`` from 1, as a long.

    The rows are range-sorted and written once, so that both passes see the same partitions; rows
    of equal keys share a partition. The driver gets one count for each partition.
    """
    spark = df.sparkSession
    path = scratch(spark, "ranks")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(parts, *keys).withColumn("part_", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    sizes = sorted((r["part_"], r["n"]) for r in placed.groupBy("part_").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    offsets = spark.createDataFrame(starts, "part_ int, before_ long")
    local = (function if function is not None else F.row_number()).over(Window.partitionBy("part_").orderBy(*keys))
    return placed.join(F.broadcast(offsets), "part_").withColumn(name, local + F.col("before_")).drop("part_", "before_")
