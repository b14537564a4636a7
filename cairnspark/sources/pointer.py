"""A small JSON value behind numbered snapshots: compare-and-swap by a rename that doesn't overwrite.

A snapshot is written to a temporary file and renamed to the next number. The rename fails if that number is taken, so of
two writers one fails and sees it, and a crash leaves nothing under a number. File systems whose rename checks and moves
in one step (HDFS, local disks) are supported; object stores without such a rename need a catalog of their own.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


class Conflict(ValueError):
    """Another writer was first."""


@dataclass
class Pointer:
    spark: SparkSession
    folder: str

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path("")):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(self._path("")) if s.getPath().getName().isdigit())

    def latest(self, default):
        """The number and value of the newest snapshot that can be read; a torn one, as other software may leave, is passed over."""
        numbers = self._numbers()
        for n in reversed(numbers):
            reader = self._fs().open(self._path(str(n)))
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(reader, "UTF-8")
            finally:
                reader.close()
            try:
                return numbers[-1], json.loads(text)
            except ValueError:
                continue
        return (numbers[-1] if numbers else 0), default

    def swap(self, number: int, value) -> None:
        """Makes `value` the snapshot after `number`; Conflict if there is one already."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        own, to = self._path(f".{uuid.uuid4().hex}"), self._path(str(number + 1))
        fs = self._fs()
        out = fs.create(own, False)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        none = sc._gateway.new_array(kind, 1)
        none[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(own, to, none)
        except Exception as e:
            fs.delete(own, False)
            if fs.exists(to):
                raise Conflict("another writer was first") from e
            raise
