"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a session in local mode without that setting gets a folder of its own, since there the driver is the only machine.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _kept(spark: SparkSession, path: str, df: DataFrame, table: str | None = None) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.stored_at = path, table
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again.

    It cuts the lineage: whoever reads the result is not affected by executors lost later. The table goes when
    the application ends, or with ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return _kept(spark, path, spark.read.schema(df.schema).parquet(path))


def sorted_table(df: DataFrame, name: str, buckets: int, *key: str) -> DataFrame:
    """``written`` as a table dealt into buckets by ``key`` and sorted in them, so that joins by the key need no shuffle of it."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.format("parquet").bucketBy(buckets, *key).sortBy(*key).option("path", path).saveAsTable(table)
    return _kept(spark, path, spark.table(table), table)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it is a table of ``written`` already, else written: so what makes it runs once."""
    return df if hasattr(df, "stored_at") else written(df, name)


@contextmanager
def few_at_a_time(spark: SparkSession, rows: int):
    """Python workers get so many rows at a time, where rows are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def dealt_out(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores, so that a small table doesn't leave the work that a row makes to a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` and ``sorted_table`` that nothing will read any more."""
    for df in tables:
        spark, (path, table) = df.sparkSession, df.stored_at
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
