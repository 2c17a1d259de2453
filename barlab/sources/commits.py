"""Numbered commit records of a folder: what readers see changes by one small file at a time.

Data files are written first, under a name of their own; a record then lists all folders that count. Record n + 1 may
be made by one writer only, as the file system refuses to create an existing file. A writer that comes second looks
at the new state and tries again; a writer that dies leaves files that no record names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Commits:
    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._read = spark._jvm.org.apache.commons.io.IOUtils.toByteArray
        self.files = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _record(self, number: int):
        return self._paths(f"{self.path}/_commits/{number:012d}.json")

    def latest(self) -> tuple[int, dict]:
        """The number and content of the last complete record; (0, {}) before the first one."""
        folder = self._paths(f"{self.path}/_commits")
        if not self.files.exists(folder):
            return 0, {}
        names = sorted((f.getPath().getName() for f in self.files.listStatus(folder)), reverse=True)
        for name in names:
            if name.endswith(".json") and not name.startswith((".", "_")):
                stream = self.files.open(self._paths(f"{self.path}/_commits/{name}"))
                try:
                    return int(name[:12]), json.loads(bytes(self._read(stream)).decode())
                except ValueError:
                    continue  # its writer is not done
                finally:
                    stream.close()
        return 0, {}

    def commit(self, number: int, record: dict) -> bool:
        """Make record `number`; False if another writer has made it."""
        if self.files.exists(self._record(number)):
            return False
        try:
            stream = self.files.create(self._record(number), False)
        except Exception as error:  # noqa: BLE001 - py4j wraps the file system's own exception
            if self.files.exists(self._record(number)):
                return False
            raise error
        try:
            stream.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        finally:
            stream.close()
        return True

    def new_folder(self, number: int) -> str:
        """A folder for the data of an attempt at record `number`."""
        return f"{self.path}/parts/commit={number}-{uuid.uuid4().hex}"

    def discard(self, folder: str) -> None:
        """Remove the data of an own attempt that came second."""
        self.files.delete(self._paths(folder), True)
