"""Writing an intermediate result down once, and removing it when its owner is done."""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_loose: list[tuple[SparkSession, str]] = []
_thread = threading.local()


def _owners() -> list[list[tuple[SparkSession, str]]]:
    """Those of this thread, the innermost last; a stream's batches run in threads of their own."""
    if not hasattr(_thread, "owners"):
        _thread.owners = [_loose]
    return _thread.owners


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate results. Where none is named, a folder
    of the warehouse, which executors share as well."""
    folder = spark.conf.get(SETTING, None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once however often it is read,
    and still there when executors are lost. Later filters and column choices reach
    the files. It is removed with its owner: the surrounding :func:`owner`, else
    :func:`release`, which also runs when the program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _owners()[-1].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def owner() -> Iterator[None]:
    """Tables written inside are removed at the end; what is made of them has to be written
    elsewhere, or read, before that."""
    mine: list = []
    _owners().append(mine)
    try:
        yield
    finally:
        _owners().pop()
        _remove(mine)


def release() -> None:
    """Remove the tables that no :func:`owner` holds."""
    _remove(_loose)


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        spark, path = tables.pop()
        if spark.sparkContext._jsc is not None:  # else the session has ended
            remove_folder(spark, path)


def adopt(spark: SparkSession, path: str) -> str:
    """Remove ``path`` with the staged tables of the owner of this moment."""
    _owners()[-1].append((spark, path))
    return path


def make_folder(spark: SparkSession, path: str) -> str:
    """``path``, which is there afterwards."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(place)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone before
        release()


atexit.register(_at_exit)
