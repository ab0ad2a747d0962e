"""Cutting lineage in iterative operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application in spark.checkpoint.dir, which all machines share. Only a session on a single machine may
    name none (tests); it has a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        found = f"file://{tempfile.gettempdir()}"
    return f"{found}/citegrid-core-{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read back: computed once, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame) -> DataFrame:
    """The same with its partitions and the order of their rows kept, as an RDD checkpoint."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def drop_checkpoints(spark: SparkSession) -> None:
    """Delete what this application has cut; results that still read it are gone too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
