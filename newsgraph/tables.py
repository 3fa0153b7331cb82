"""Tables: the given parquet inputs, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: the one in spark.checkpoint.dir.

    Where the setting is absent in a local session (as in tests) a temporary folder is set on the
    context, which is safe because one machine holds everything; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="newsgraph-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh table location in the shared folder."""
    return f"{shared_dir(spark)}/newsgraph/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, executors may go."""
    path = table_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _entry(path: str) -> str:
    """Name in the catalog of the bucketed table in this folder."""
    return f"newsgraph_{path.rpartition('/')[2].replace('-', '_')}"


def materialize_bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """``materialize`` into so many buckets by ``key``, without a shuffle: a join on ``key`` then moves the other side only."""
    spark = df.sparkSession
    path = table_path(spark, name)
    table_name = _entry(path)
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(table_name)
    return spark.table(table_name)


def spread(df: DataFrame) -> DataFrame:
    """Rows that lie in fewer partitions than the cluster has cores are dealt over all; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows in partitions of about ``rows``, by ``keys`` where given: rows that repeat are a small file, of which Spark would give much to one task."""
    n = max(1, -(-df.count() // rows))
    return df.repartition(n, *keys) if keys or df.rdd.getNumPartitions() < n else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """Marks a side of a join that must not be sent through the driver: rows of lists and texts that repeat are a small file, by which Spark judges, and large in memory."""
    return df.hint("merge")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on whatever file system the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete an intermediate table once nothing reads it any more, and its entry in the catalog if it has one."""
    jvm = spark.sparkContext._jvm
    for folder in sorted({f.rpartition("/")[0] for f in df.inputFiles()}):
        spark.sql(f"DROP TABLE IF EXISTS `{_entry(folder)}`")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
