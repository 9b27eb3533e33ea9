"""Reading tables so that all cores have work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it comes in fewer partitions than there are cores, else as it is.

    A small file of one row group is one task, whatever stands after it. Tables of many splits, which is all of
    those that are large, are never dealt anew.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table's columns (all if none are named), spread if it is small."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)
