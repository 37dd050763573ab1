"""Intermediate results that outlive the executors which made them.

Lineage is cut by writing a table into the shared folder the cluster names in
``spark.checkpoint.dir``.  The setting is read from the session; a local folder is
chosen only for a session in local mode that names none, as in tests.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple] = []  # (where the JVM keeps its file systems' settings, the JVM, path)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Raises ``RuntimeError`` on a cluster that names none: a machine's own temporary
    folder can't be read by the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sparkloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    own = "file://" + made
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for files that go when the driver ends or :func:`release` is called."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark._jsc.hadoopConfiguration(), spark._jvm, path))
    return path


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` into the shared folder and return it read back, with its schema.

    An empty frame gives an empty table. Each call writes a folder of its own; the
    folders go when the driver ends, or earlier through :func:`release`.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables written by :func:`durable` so far."""
    while _written:
        settings, jvm, path = _written.pop()
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(settings).delete(where, True)
        except Exception:  # noqa: BLE001 - the JVM may have ended already
            pass


atexit.register(release)
