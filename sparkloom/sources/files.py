"""Small documents and listings on whatever file system a path names, through Spark's own Hadoop client."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):  # noqa: ANN202 - JVM objects
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    system, where = _at(spark, path)
    return bool(system.exists(where))


def make_folder(spark: SparkSession, path: str) -> None:
    """Create a folder and those above it."""
    system, where = _at(spark, path)
    system.mkdirs(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small document, its folders first; one that is there is replaced."""
    system, where = _at(spark, path)
    out = system.create(where, True)
    try:
        out.write(text.encode("utf-8"))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small document."""
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no) of the lines of text files, counted from 1 over the files in the order of their paths.

    The number doesn't depend on how files are split: each split's lines are counted
    first, then a line's number is those of the splits before it plus its place.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))  # one row a split
    by_file = blocks.groupBy("_file").agg(F.sum("_n").alias("_lines"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = by_file.select("_file", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before_file"))
    within = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_before_block")).join(files, "_file")
    joined = lines.join(starts, ["_file", "_block"])
    return joined.select("value", (F.col("_before_file") + F.col("_before_block") + F.col("_id") - F.col("_first") + 1).alias("line_no"))


def numbered_parquet(spark: SparkSession, path: str, name: str = "pos") -> DataFrame:
    """The rows of Parquet files with their place, from 0, over the files in the order of their paths."""
    rows = spark.read.parquet(path).withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))  # one row a file
    before = sizes.select("_file", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, "_file").withColumn(name, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")
