"""Folders of a library on any file system that Spark knows: swaps and locks through Hadoop's own interface."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quillgrid.errors import Locked


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.files.exists(self._path(f"{self.folder}/{name}"))

    def delete(self, name: str) -> None:
        self.files.delete(self._path(f"{self.folder}/{name}"), True)

    def rename(self, old: str, new: str) -> bool:
        return self.files.rename(self._path(f"{self.folder}/{old}"), self._path(f"{self.folder}/{new}"))

    @contextmanager
    def lock(self, timeout: float = 60.0, stale: float = 6 * 3600.0) -> Iterator[None]:
        """One writer at a time: a file that only one can create. A lock older than ``stale`` seconds was left by a dead writer."""
        at, until = self._path(f"{self.folder}/.lock"), time.time() + timeout
        while not self.files.createNewFile(at):
            if self.files.exists(at) and time.time() * 1000 - self.files.getFileStatus(at).getModificationTime() > stale * 1000:
                self.files.delete(at, False)
            elif time.time() > until:
                raise Locked(f"{self.folder} is locked by another writer", "try again later")
            else:
                time.sleep(0.2)
        try:
            yield
        finally:
            self.files.delete(at, False)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write a table anew beside the old one and swap the folders; the old one comes back if the swap fails."""
        mark = uuid.uuid4().hex
        staged, old = f".staging-{name}-{mark}", f".trash-{name}-{mark}"
        rows.write.parquet(f"{self.folder}/{staged}")
        had = self.exists(name)
        if had and not self.rename(name, old):
            self.delete(staged)
            raise OSError(f"{name} can't be moved")
        if not self.rename(staged, name):
            if had:
                self.rename(old, name)
            raise OSError(f"{name} can't be replaced")
        if had:
            self.delete(old)
