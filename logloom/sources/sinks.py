"""Where rows go."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from ..functions.tokenizer import render


def parquet_path(source: str) -> str:
    """The source with its last extension replaced: a.log.seek.zst -> a.log.seek.parquet."""
    return str(PurePosixPath(source).with_suffix(".parquet")) if "://" not in source else source.rpartition("://")[0] + "://" + str(PurePosixPath(source.rpartition("://")[2]).with_suffix(".parquet"))


def write_parquet(df: DataFrame, path: str, partitions: int | None = None, mode: str = "errorifexists") -> str:
    """Zstd Parquet, in as many files as there are partitions, or as asked for."""
    (df if partitions is None else df.coalesce(partitions)).write.mode(mode).option("compression", "zstd").parquet(path)
    return path


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """key=value lines of all columns."""
    df.select(render(df.columns).alias("value")).write.mode(mode).text(path)
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Only where executors are threads of this process, as in tests, may that be unset."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"file:///tmp/checkpoints/{os.getuid()}"


def _file(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    system, path = _file(spark, path)
    return system.exists(path)


def kept_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for what outlives the application, such as a fitted model."""
    return f"{shared_folder(spark)}/kept/{name}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. All paths of an application lie in one folder, which is deleted when its JVM ends."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        system, path = _file(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _folders.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_folders: set[str] = set()


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written once and read again, for what is used more than once: they are not computed again, a lost executor costs nothing, and the optimiser knows their size."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
