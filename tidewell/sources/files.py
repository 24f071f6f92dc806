"""A folder on any file system Spark knows, with the few atomic steps the engine needs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Folder:
    """Small marker and manifest files below ``root``; data files are written by Spark itself."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, jvm = root.rstrip("/"), spark._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    @staticmethod
    def token() -> str:
        return uuid.uuid4().hex[:12]

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(self.root)))

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._at(name)))

    def create(self, name: str, text: str) -> None:
        """Writes a file that must not exist; it appears whole or not at all. FileExistsError if another writer was first."""
        hidden = self._at(f".{name}.{self.token()}")
        out = self._fs.create(hidden, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # here a rename would replace the file, but a link does not
                os.link(hidden.toUri().getPath(), self._at(name).toUri().getPath())
            elif self.exists(name) or not self._fs.rename(hidden, self._at(name)):
                raise FileExistsError(name)
        finally:
            if self._fs.exists(hidden):
                self._fs.delete(hidden, False)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._at(old), self._at(new)):
            raise OSError(f"cannot rename {old} to {new} in {self.root}")

    def ages(self) -> dict[str, float]:
        """File name to the seconds since it was written, by the clock of this machine."""
        import time

        now = time.time() * 1000
        return {x.getPath().getName(): (now - x.getModificationTime()) / 1000 for x in self._fs.listStatus(self._path(self.root))}

    def sizes(self, name: str = "") -> dict[str, int]:
        """File name to length, of the files directly in a subfolder."""
        return {x.getPath().getName(): x.getLen() for x in self._fs.listStatus(self._at(name)) if not x.isDirectory()}
