"""Small driver-side files through Hadoop's file system, so that any store that Spark reads will do."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Taken(OSError):
    """The name has been published by another writer."""


class Files:
    """Reads, lists and publishes small text files; a published file is whole and never changes."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self.root = root
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def publish(self, name: str, text: str) -> None:
        """Writes a draft and gives it its name, which is the point of commitment; of two writers of one name the second gets Taken."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        self.write(draft, text.encode())
        try:
            self._name(draft, name)
        finally:
            self.remove(draft)

    def _name(self, draft: str, name: str) -> None:
        if self._fs.getScheme() == "file":  # its rename would replace the other writer's file
            try:
                os.link(*(self._path(n).toUri().getPath() for n in (draft, name)))
            except FileExistsError as e:
                raise Taken(name) from e
            return
        never = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._path(draft), self._path(name), never)
        except Exception as e:
            raise (Taken(name) if self._fs.exists(self._path(name)) else OSError(f"{name} could not be published")) from e

    def write(self, name: str, data: bytes) -> None:
        """Writes one file."""
        out = self._fs.create(self._path(name), True)
        out.write(bytearray(data))
        out.close()

    def read(self, name: str) -> str:
        source = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def names(self, folder: str) -> list[str]:
        """Published names in a folder, ascending."""
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".json"))

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
