"""Tables kept in the shared checkpoint folder, to cut lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a master in this process gets a folder of its own (tests, local
    runs); on a cluster, whose machines share no such folder, it is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="offerlens-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df once as a Parquet table in the shared folder and read that instead."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_batches(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """Jobs that start inside hand their rows to Python in Arrow batches of at most this size (Spark's own bound is 64 MB, held
    by the executor and the worker alike); the session's setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
