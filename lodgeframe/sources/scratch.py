"""A folder every executor can reach, for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; on a local master a temporary one if none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    # a machine's own folder is shared only where all tasks run in this process
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="lodgeframe-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Owned:
    """The tables written inside of a scope, by their paths."""

    def __init__(self):
        self.paths: dict[str, SparkSession] = {}
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """Leave a table of written() to the scope around this one, or on disk if there is none."""
        self.kept.add(df._scratch_path)
        return df


_scope: ContextVar[Owned | None] = ContextVar("scope", default=None)


@contextmanager
def scope() -> Iterator[Owned]:
    """Delete on leaving what written() wrote inside, but for what is kept.

    For steps that end with a written table: what comes after reads that table only, so nothing that is deleted is
    needed again, not even if executors are lost. Scopes may be nested.
    """
    owned = Owned()
    outer = _scope.get()
    token = _scope.set(owned)
    try:
        yield owned
    finally:
        _scope.reset(token)
        for path, spark in owned.paths.items():
            if path in owned.kept:
                if outer is not None:
                    outer.paths[path] = spark
            else:
                delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Delete a table of written() before its scope ends, when all that reads it has been written."""
    delete(df.sparkSession, df._scratch_path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from the files."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same as parquet, where later steps read only some of the columns."""
    path = new_path(df.sparkSession, name)
    owner = _scope.get()
    if owner is not None:
        owner.paths[path] = df.sparkSession
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back
