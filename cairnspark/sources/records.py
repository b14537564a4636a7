"""Small tables that change: each change writes a new snapshot of the table and swaps a pointer to it."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.sources.pointer import Pointer


class Exists(ValueError):
    """A row of these keys is there already."""


class NotFound(ValueError):
    """No row of these keys."""


@dataclass
class Records:
    """A keyed table under a folder. Reads see the last whole snapshot; of two writers one gets Conflict and may try again.

    A small table's rows are the snapshot; a large one's lie in a Parquet folder that the snapshot names.
    """

    spark: SparkSession
    folder: str
    schema: str
    keys: tuple[str, ...]
    large: bool = False

    def _pointer(self) -> Pointer:
        return Pointer(self.spark, f"{self.folder}/_at")

    def rows(self) -> DataFrame:
        return self._read(self._pointer().latest(None)[1])

    def _read(self, at) -> DataFrame:
        if not self.large:
            return self.spark.createDataFrame([tuple(r) for r in at or ()], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{at}") if at else self.spark.createDataFrame([], self.schema)

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def change(self, change) -> None:
        """Makes change(rows) the table."""
        number, at = self._pointer().latest(None)
        rows = change(self._read(at)).select(*self._columns())
        if self.large:
            name = uuid.uuid4().hex
            rows.write.parquet(f"{self.folder}/{name}")
            self._pointer().swap(number, name)
        else:
            self._pointer().swap(number, [list(r) for r in rows.collect()])

    def _insert(self, rows, fresh: bool) -> None:
        if self.large:
            new = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, self.schema)
            if fresh and not self.rows().join(new, list(self.keys), "left_semi").isEmpty():
                raise Exists(f"{self.folder.rsplit('/', 1)[-1]}: there already")
            return self.change(lambda old: old.join(new.select(*self.keys), list(self.keys), "left_anti").unionByName(new))
        names = self._columns()
        new = [list(r) for r in (rows.select(*names).collect() if isinstance(rows, DataFrame) else rows)]
        at = [names.index(k) for k in self.keys]
        key = lambda r: tuple(r[i] for i in at)
        number, old = self._pointer().latest(None)
        keys = {key(r) for r in new}
        if fresh and any(key(r) in keys for r in old or ()):
            raise Exists(f"{self.folder.rsplit('/', 1)[-1]}: there already")
        self._pointer().swap(number, [r for r in old or () if key(r) not in keys] + list({key(r): r for r in new}.values()))

    def put(self, rows) -> None:
        """Puts rows in; rows of the same keys are replaced."""
        self._insert(rows, False)

    def add(self, rows) -> None:
        """Puts rows in; Exists if there is one of the same keys."""
        self._insert(rows, True)

    def update(self, which: Column, **values: Column) -> None:
        """Sets columns of the rows that `which` picks; NotFound if there are none."""
        def change(old):
            if old.where(which).isEmpty():
                raise NotFound(f"{self.folder.rsplit('/', 1)[-1]}: no such row")
            picked = F.coalesce(which, F.lit(False))
            return old.select(*[F.when(picked, values[c]).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c in values else F.col(c) for c in old.columns])

        self.change(change)

    def delete(self, which: Column) -> None:
        self.change(lambda old: old.where(~F.coalesce(which, F.lit(False))))

    def get(self, **key):
        """The row of these keys; NotFound if there is none."""
        rows = self.rows()
        for k, v in key.items():
            rows = rows.where(F.col(k) == v)
        row = rows.first()
        if row is None:
            raise NotFound(f"{self.folder.rsplit('/', 1)[-1]}: {key}")
        return row


@dataclass
class KeyValues:
    """JSON values of any size under string keys."""

    spark: SparkSession
    folder: str

    def _records(self) -> Records:
        return Records(self.spark, self.folder, "key string, value string", ("key",))

    def put(self, key: str, value) -> None:
        self._records().put([(key, json.dumps(value, sort_keys=True))])

    def get(self, key: str):
        return json.loads(self._records().get(key=key)["value"])

    def delete(self, key: str) -> None:
        self._records().delete(F.col("key") == key)

    def scan(self, prefix: str) -> list[tuple[str, object]]:
        """(key, value) of all keys with a prefix, in order."""
        return [(r["key"], json.loads(r["value"])) for r in self._records().rows().where(F.col("key").startswith(prefix)).orderBy("key").collect()]
