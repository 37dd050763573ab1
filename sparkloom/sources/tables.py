"""Named Parquet tables below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` below ``folder``; column pruning and filters reach its scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan with fewer splits than half the cores, as of one small file, dealt to all cores; others as they are.

    For work that is long per row. A table of any size has more splits than that, so
    nothing large is ever moved. Columns and filters still reach the scan.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() < cores else rows
