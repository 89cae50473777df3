"""Reading of tables, sizes of broadcasts, and keys and partitions of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators.lineage import cut

__all__ = ["cut", "small", "spread", "spread_nulls", "table"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns (all, if none are named) of a test table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


FEW = 100_000  # rows of a table that may be broadcast


def small(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` with the hint to broadcast it if it has at most ``most`` rows, else as it is: Spark then joins by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread_nulls(key: str, row_id: str) -> Column:
    """A join key whose nulls, which match nothing, go to as many partitions as there are rows instead of one."""
    return F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col(row_id).cast("string")))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan for Python kernels, on at least as many partitions as there are cores.

    A scan of a few small files gives fewer tasks than cores; its rows are then dealt out evenly. Larger scans stay as they are,
    so nothing is shuffled at scale. Only for scans, filtered and projected: to count the partitions of a join would run it.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
