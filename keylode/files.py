"""Small files next to tables, through Hadoop's file systems."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


#: Stores that replace a file by a rename in one step.
RENAMING = ("file", "hdfs", "viewfs")


class Files:
    def __init__(self, spark: SparkSession):
        self.gateway = spark.sparkContext._gateway
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def system(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self.system(name).exists(self.path(name))

    def stat(self, name: str) -> tuple[int, int]:
        """Size and modification time in nanoseconds; FileNotFoundError if absent."""
        if not self.exists(name):
            raise FileNotFoundError(name)
        status = self.system(name).getFileStatus(self.path(name))
        return status.getLen(), status.getModificationTime() * 1_000_000

    def delete(self, name: str) -> None:
        self.system(name).delete(self.path(name), True)

    def children(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system(name).listStatus(self.path(name))) if self.exists(name) else []

    def read(self, name: str) -> bytes:
        stream = self.system(name).open(self.path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def put(self, name: str, data: bytes) -> None:
        """Readers see the old or the new file: where a rename is one step, data is written
        aside and renamed over; other stores, object stores, show a file once it is whole."""
        system = self.system(name)
        aside = f"{name}.{uuid.uuid4().hex}.new" if system.getUri().getScheme() in RENAMING else name
        system.setWriteChecksum(False)  # a local checksum file would forbid edits by other tools
        try:
            stream = system.create(self.path(aside), True)
            stream.write(bytearray(data))
            stream.close()
        finally:
            system.setWriteChecksum(True)
        if aside != name:
            self._over(aside, name)

    def _over(self, aside: str, name: str) -> None:
        old, new, system = self.path(name), self.path(aside), self.system(name)
        if system.getUri().getScheme() == "file":  # the system call replaces the target
            system.delete(system.getChecksumFile(old), False)  # it speaks of the file before
            os.replace(new.toUri().getPath(), old.toUri().getPath())
            return
        fs = self.jvm.org.apache.hadoop.fs
        over = self.gateway.new_array(getattr(fs, "Options$Rename"), 1)
        over[0] = getattr(fs, "Options$Rename").OVERWRITE
        fs.FileContext.getFileContext(system.getUri(), self.conf).rename(system.makeQualified(new), system.makeQualified(old), over)

    def last_byte(self, name: str) -> bytes:
        """The last byte of a file, empty for an empty one."""
        size, _ = self.stat(name)
        if not size:
            return b""
        stream = self.system(name).open(self.path(name))
        try:
            stream.seek(size - 1)
            return bytes([stream.read()])
        finally:
            stream.close()

    def append(self, name: str, data: bytes) -> None:
        """Add to the end of a file; what it holds isn't read.  A store that can't append
        refuses it."""
        system, path = self.system(name), self.path(name)
        if system.getUri().getScheme() == "file":
            system.delete(system.getChecksumFile(path), False)  # it speaks of the file before
            system = system.getRawFileSystem()
        stream = system.append(path)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def read_json(self, name: str) -> dict:
        return json.loads(self.read(name))
