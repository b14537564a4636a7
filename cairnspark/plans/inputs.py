"""The engine's tables as views of the driver's tables: two versions of a document tree, a version graph, refs, sessions, workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnspark.functions.digest import digest

#: A clock for queries, so that none reads the time: 2024-01-01 00:00 UTC.
NOW = 1_704_067_200
#: A clock after all events of the driver's tables: 2030-01-01 00:00 UTC.
AFTER = 1_893_456_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path() -> F.Column:
    return F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, doc_id of all documents."""
    return table(spark, sf_dir, "documents").select(path().alias("path"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")


def version(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Version "a" lacks every tenth document; "b" lacks every eleventh and has changed every seventh."""
    f = files(spark, sf_dir)
    if side == "a":
        return f.where(F.col("doc_id") % 10 != 0)
    return f.where(F.col("doc_id") % 11 != 0).withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))


def hashed(f: DataFrame) -> DataFrame:
    """path, hash, size (bytes)."""
    return f.select("path", digest(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("size"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """branch (customer), version_id (order), seq, p0, p1: parents are the customer's last and last but one order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("branch"), F.col("o_orderkey").alias("version_id"), F.row_number().over(w).alias("seq"), F.lag("o_orderkey", 1).over(w).alias("p0"), F.lag("o_orderkey", 2).over(w).alias("p1"))


def edges(v: DataFrame) -> DataFrame:
    return v.select("version_id", F.posexplode(F.array("p0", "p1")).alias("ordinal", "parent_id")).where("parent_id IS NOT NULL")


def tips(v: DataFrame) -> DataFrame:
    """branch, version_id: the last version of each branch."""
    return v.groupBy("branch").agg(F.max_by("version_id", "seq").alias("version_id"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, kind, target: a branch for each customer, a tag for each fifth order."""
    v = versions(spark, sf_dir)
    branches = tips(v).select(F.concat(F.lit("branch-"), F.col("branch").cast("string")).alias("name"), F.lit("branch").alias("kind"), F.col("version_id").alias("target"))
    tags = v.where("version_id % 5 = 0").select(F.concat(F.lit("tag-"), F.col("version_id").cast("string")).alias("name"), F.lit("tag").alias("kind"), F.col("version_id").alias("target"))
    return branches.unionByName(tags)


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """version_id, hash: an order's objects are the digests of its parts."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("version_id"), digest(F.col("l_partkey").cast("string")).alias("hash")).distinct()


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, remote, direction, status, started_at (seconds), from events."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "completed").otherwise("failed")
    return e.select(F.col("event_id").alias("session_id"), F.col("user_id").alias("remote"), F.when(F.col("event_id") % 2 == 0, "push").otherwise("pull").alias("direction"), status.alias("status"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("started_at"))


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, deleted_at, metadata from customers: retention of 7, 14, 30 days, malformed, or none."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    meta = F.when(k % 5 == 0, '{"recycle_retention_days": 7}').when(k % 5 == 1, '{"recycle_retention_days": 14}').when(k % 5 == 2, '{"recycle_retention_days": "x"}').when(k % 5 == 3, "{}")
    return c.select(k.alias("id"), F.when(k % 4 != 0, F.lit(NOW) - (k % 40) * 86400).cast("long").alias("deleted_at"), meta.alias("metadata"))
