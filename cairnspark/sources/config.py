"""Which store an engine works on: from a TOML file or from the environment, one of a local folder and a cloud address."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass

from pyspark.sql import SparkSession

from cairnspark.sources.warehouse import Warehouse


@dataclass(frozen=True)
class Config:
    local: str | None = None
    cloud: str | None = None

    def __post_init__(self):
        if bool(self.local) == bool(self.cloud):
            raise ValueError("exactly one of a local folder and a cloud address must be set")
        if self.cloud and "://" not in self.cloud:
            raise ValueError(f"not an address of a store: {self.cloud!r}")

    @classmethod
    def from_file(cls, path: str) -> "Config":
        """[store] with local or cloud."""
        with open(path, "rb") as f:
            found = tomllib.load(f).get("store", {})
        return cls(found.get("local"), found.get("cloud"))

    @classmethod
    def from_env(cls, env=os.environ) -> "Config":
        """CAIRN_LOCAL or CAIRN_CLOUD."""
        return cls(env.get("CAIRN_LOCAL"), env.get("CAIRN_CLOUD"))

    def open(self, spark: SparkSession) -> Warehouse:
        w = Warehouse(spark, self.cloud.rstrip("/") if self.cloud else f"file://{os.path.abspath(self.local)}")
        w.layout()  # brings an older store up to date
        return w
