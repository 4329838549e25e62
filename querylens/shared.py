"""The shared folder and cuts of lineage that survive the loss of executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Only on a single machine where ``spark.checkpoint.dir`` is unset, as in
    tests, a temporary folder of our own stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="querylens-")
        base = _OWN_DIRS[app]
    return base.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/querylens/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._querylens_path = path
    return read


def drop_table(df: DataFrame) -> None:
    """Remove a table of materialize() that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_querylens_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release_exchanges(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the files of exchanges that nothing refers to any more; it learns of them from the JVM's collector."""
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer splits than there are cores, before work that is heavy for each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def dense_blocks(df: DataFrame, key: str, rows: int) -> list[DataFrame]:
    """df in blocks of so many rows at most by the order of their key; a single one where df is no larger."""
    if df.limit(rows + 1).count() <= rows:
        return [df]
    placed = materialize(df.repartitionByRange(-(-df.count() // rows) * 2, key).withColumn("_block", F.spark_partition_id()), "blocks")
    return [placed.where(F.col("_block") == r["_block"]).drop("_block") for r in placed.select("_block").distinct().collect()]


#: Rows of a table that may go to every task.
SMALL_ROWS = 10_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than so many rows, else as it is: the engine then exchanges both sides of a join."""
    return F.broadcast(df) if is_small(df, rows) else df
