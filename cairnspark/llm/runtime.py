"""What the operators need from a session: the shared folder, tables written to it, and this package on the executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from cairnspark.sources.shipping import ship  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a folder of our own, if all runs in one process; else RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cairn-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cairn/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """`df` as a table in the shared folder: it cuts the lineage and outlives executors."""
    path = fresh_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)
    out._cairn_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_cairn_path", None)
        if path:
            delete_path(t.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def in_full(df: DataFrame) -> list[Column]:
    """Columns that order the rows of `df` by everything in them: rows that tie are equal, so numbers survive a second run."""
    return [F.col(f"`{f.name}`") if isinstance(f.dataType, AtomicType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema.fields]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def one_to_a_task(spark: SparkSession, n: int) -> list[int]:
    """n numbers that repartition(n, column) puts into n different partitions."""
    found: dict[int, int] = {}
    tried = 64 * n
    while len(found) < n:
        tried *= 2
        label = F.col("id").cast("int")
        found = {r["p"]: r["label"] for r in spark.range(tried).groupBy(F.pmod(F.hash(label), F.lit(n)).alias("p")).agg(F.min(label).alias("label")).collect()}
    return [found[p] for p in range(n)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
