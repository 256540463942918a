"""Reading parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Only inputs up to this size are dealt again, so a read shuffles at most so much.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a small file that the scan cannot split.

    A file with one row group is one task. Larger inputs are left as the scan cuts them
    (``spark.sql.files.maxPartitionBytes``, row groups): they never shuffle here, and on
    any cluster at most ``SMALL_BYTES`` do.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if int(str(size)) <= SMALL_BYTES else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, on any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table for per-row text work: pruned first, then spread over the cores."""
    df = table(spark, folder, name)
    return spread(df.select(*columns) if columns else df)
