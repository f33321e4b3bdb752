"""Cutting long plans at a reliable checkpoint."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SETTING = "spark.checkpoint.dir"
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Makes sure a checkpoint folder is set: the one the cluster names, or in local mode a new scratch folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get(SETTING, None) or sc.getConf().get(SETTING, None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-checkpoint-"))
    else:
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the checkpoint folder: computed once, kept when executors are lost."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query are removed as soon as it ends, not when the driver's memory is next cleaned."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def store(df: DataFrame) -> str:
    """Writes the rows as a Parquet table in the checkpoint folder, and gives its folder."""
    prepare(df.sparkSession)
    base = df.sparkSession.sparkContext.getCheckpointDir()
    folder = f"{re.sub('^file:/+', 'file:///', base if ':' in base else f'file://{base}')}/{uuid.uuid4().hex}"
    df.write.parquet(folder, compression="zstd")
    return folder


def load(spark: SparkSession, schema: T.StructType, folders: list[str]) -> DataFrame:
    """The rows of tables of :func:`store` that have one schema."""
    return spark.read.schema(schema).parquet(*folders)


def drop(spark: SparkSession, folders: list[str]) -> None:
    """Removes tables of :func:`store` that no query reads any more."""
    sc = spark.sparkContext
    for folder in folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the checkpoint folder: like :func:`cut`, and columns that are not asked for are not read."""
    return load(df.sparkSession, df.schema, [store(df)])
