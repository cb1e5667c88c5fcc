"""Parquet tables: one write per version, partition overwrite, partition-pruned reads."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.session import new_folder, shared_dir


def gathered(df: DataFrame, partition_by: str) -> DataFrame:
    """Rows of a partition brought together: AQE merges small pieces and splits large ones."""
    return df.hint("rebalance", F.col(partition_by))


def write_table(
    df: DataFrame, path: str, partition_by: str | None = None, sort_by: str | None = None, exchange: bool = True
) -> DataFrame:
    """Write and read back.

    Partitioned tables are rebalanced on the partition column first: AQE merges small
    pieces and splits large ones, so a quarter gets few files yet never one huge task.
    Without ``exchange`` each task writes its rows where they are, a file for each value
    it holds: for a table of many rows that its plan has just exchanged.
    ``sort_by`` orders the rows inside each file, so that a filter on it skips row groups.
    """
    spark, schema = df.sparkSession, df.schema
    out = gathered(df, partition_by) if partition_by and exchange else df
    if partition_by and sort_by:
        out = out.sortWithinPartitions(partition_by, sort_by)
    # static: an overwrite replaces the table, so partitions without rows disappear too
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return read_table(spark, path, schema).select(*df.columns)


def store_once(df: DataFrame, path: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Fix rows that must not be evaluated twice, in the shared folder or, without one, on the executors' disks.

    With ``partition_by`` each task writes a file for each value it holds, so that a filter on it skips the others.
    """
    if path is None and shared_dir(df.sparkSession) is None:
        return df.persist(StorageLevel.DISK_ONLY)
    return write_table(df, path or new_folder(df.sparkSession, "once"), partition_by, exchange=False)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Add one batch to a raw table.  Running it again replaces the batch, never doubles it."""
    (
        df.withColumn("etl_batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("etl_batch_id")
        .parquet(path)
    )


def overwrite_partitions(df: DataFrame, path: str, partition_by: str) -> None:
    """Replace exactly the partitions that occur in ``df``; others stay as they are.

    ``df`` must not read ``path`` itself.  Each task writes its rows where they are; ``gathered`` rows make few files.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_by)
        .parquet(path)
    )
