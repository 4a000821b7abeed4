"""The folder that a cluster's machines share, and tables in it that queries store for use more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); on a local master without one, a temporary folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and (own := sc._jsc.sc().getCheckpointDir()).isDefined():
        named = own.get()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named := tempfile.mkdtemp(prefix="spark-shared-"))
    return named.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """Where all tables of this application lie."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A name for a new folder there."""
    return f"{application_dir(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared folder and read again: it cuts the lineage and outlives lost executors."""
    df.write.parquet(path := new_folder(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession) -> None:
    """Removes all tables that this application stored: call it when the results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
