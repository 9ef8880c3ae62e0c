"""Versions of a small state: one JSON file each, numbered from 1, in a folder that all readers share.

A version is written beside the log and then renamed to its number, without overwriting: it is there whole or
not at all, and of two writers that start from one version the second fails. Readers name a version, or take
the last one when they begin, and see nothing of what comes later.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from ..errors import StoreError


class Folder:
    """Files of a folder through Hadoop's file systems, whichever the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def names(self, name: str = "") -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs().listStatus(path)) if self._fs().exists(path) else []

    def state(self) -> tuple:
        """Names, sizes and times of the files: equal as long as nothing has changed. The folder may be a file."""
        return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in self._fs().listStatus(self._path(""))))

    def read(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs().create(self._path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        """Fails if new is there."""
        fs = self._jvm.org.apache.hadoop.fs
        nothing = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        fs.FileContext.getFileContext(self._path("").toUri(), self._conf).rename(self._path(old), self._path(new), nothing)

    def delete(self, name: str = "") -> None:
        self._fs().delete(self._path(name), True)


class Log:
    def __init__(self, spark: SparkSession, root: str):
        self.folder = Folder(spark, f"{root.rstrip('/')}/log")

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names() if n.endswith(".json"))

    def latest(self) -> int:
        """The last version, 0 before the first."""
        return max(self.versions(), default=0)

    def read(self, version: int) -> dict | None:
        """The state of a version; None for version 0."""
        if not version:
            return None
        try:
            return json.loads(self.folder.read(f"{version:012d}.json"))
        except Exception as e:  # noqa: BLE001  whatever the file system says
            raise StoreError("STORAGE_READ_FAILED", f"no version {version}") from e

    def commit(self, version: int, state: dict) -> None:
        """Make state this version; fails, and changes nothing, if another writer was first."""
        draft = f"draft-{uuid.uuid4().hex}"
        try:
            self.folder.write(draft, json.dumps(state))
            self.folder.rename(draft, f"{version:012d}.json")
        except Exception as e:  # noqa: BLE001  whatever the file system says
            self.folder.delete(draft)
            raise StoreError("STORAGE_CONSISTENCY", f"version {version} was not written") from e

    def forget_before(self, version: int) -> None:
        """Versions before this one can no longer be read."""
        for v in self.versions():
            if v < version:
                self.folder.delete(f"{v:012d}.json")
