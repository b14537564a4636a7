"""Cancelling long operations from another thread."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    pass


class CancelToken:
    """Operations run `within` a token end with Cancelled once cancel() was called: running jobs are killed, later ones don't begin."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.cancelled = spark, f"cairn-{uuid.uuid4().hex}", False

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled("cancelled")

    @contextmanager
    def within(self):
        self.check()
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            yield self
        except Exception as e:
            if self.cancelled:
                raise Cancelled("cancelled") from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
        self.check()
