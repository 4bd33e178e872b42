"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    That is ``spark.checkpoint.dir``. Only where it is unset and everything runs on one
    machine, as in tests, a new local folder is made and becomes the session's setting; on a
    cluster an unset folder is an error, as executors could not see a local one.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", conf)
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder, in a subfolder per value of ``by``, and read it back.

    This cuts lineage: a lost executor costs only the tasks that were running,
    and a table that several branches read is computed once.
    """
    path = new_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """For work that takes more time than moving its rows: a table in under half as many partitions as there are
    cores (a small file in one row group, say) is dealt out to all of them; larger tables stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def dealt(df: DataFrame) -> DataFrame:
    """For work that takes very much more time than moving its rows: a table is dealt out to several tasks a core, however it
    lies. Its partitions tell little of that: those within one row group of a file but one are empty."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(4 * cores, 2 * df.rdd.getNumPartitions()))
