"""Turns of programs that write to one folder."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from logwarden.stage import remove_folder


class LostTurn(Exception):
    """Another program took over: what was worked out from the old state must not count."""


class Turn:
    """Holds ``folder/turn`` while its work lasts. The file is created only if it is not there,
    which file systems do as one step, so of several programs one goes on and the others wait.
    A file older than ``lease`` seconds belongs to a program that is gone and is taken over;
    whoever it was finds out by :meth:`check` before anything of its work becomes visible."""

    def __init__(self, spark: SparkSession, folder: str, lease: float, pause: float = 0.2):
        self.spark, self.lease, self.pause = spark, lease, pause
        self.place = f"{folder}/turn"
        self.token = uuid.uuid4().hex
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path(self.place)
        self._files = self._path.getFileSystem(context._jsc.hadoopConfiguration())

    def __enter__(self) -> Turn:
        while not self._create():
            age = self._age()
            if age is not None and age > self.lease:
                remove_folder(self.spark, self.place)
            else:
                time.sleep(self.pause)
        return self

    def __exit__(self, *_) -> None:
        if self._holder() == self.token:
            remove_folder(self.spark, self.place)

    def check(self) -> None:
        if self._holder() != self.token:
            raise LostTurn(self.place)

    def _create(self) -> bool:
        try:
            out = self._files.create(self._path, False)
        except (Py4JJavaError, PySparkException):
            if self._age() is None:  # not there, yet it cannot be created
                self._files.mkdirs(self._path.getParent())
            return False
        out.write(bytearray(self.token.encode()))
        out.close()
        return True

    def _age(self) -> float | None:
        try:
            status = self._files.getFileStatus(self._path)
        except (Py4JJavaError, PySparkException):
            return None
        return time.time() - status.getModificationTime() / 1000

    def _holder(self) -> str | None:
        try:
            stream = self._files.open(self._path)
        except (Py4JJavaError, PySparkException):
            return None
        try:
            utils = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
            return utils.toString(stream, "UTF-8")
        finally:
            stream.close()
