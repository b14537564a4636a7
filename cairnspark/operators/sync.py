"""Exchange between two warehouses: inventories, need sets, resumption, packs, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.digest import digest
from cairnspark.operators.chunking import shard_of

#: 64 MiB an object, 4 GiB a session.
OBJECT_BYTES, SESSION_BYTES = 64 << 20, 4 << 30
#: Objects go in this order, so that what refers to others comes after nothing it needs is missing.
TYPE_RANK = {"version": 0, "tree": 1, "node": 2, "chunk": 3}


def need_set(offered: DataFrame, held: DataFrame) -> DataFrame:
    """Objects (obj_type, hash) offered that the other side doesn't hold."""
    return offered.select("obj_type", "hash").distinct().join(held, ["obj_type", "hash"], "left_anti")


def resume_filter(need: DataFrame, manifest: DataFrame) -> DataFrame:
    """What is needed and not yet in the session's manifest of sent digests."""
    return need.join(manifest.select("hash"), "hash", "left_anti")


def sharded(objects: DataFrame, shards: int) -> DataFrame:
    """shard, obj_type, n, of digests dealt by first byte; transfers then run a shard to a task."""
    return objects.groupBy(shard_of(F.col("hash"), shards).alias("shard"), "obj_type").agg(F.count("*").alias("n"))


def in_transfer_order(objects: DataFrame) -> DataFrame:
    rank = F.coalesce(*[F.when(F.col("obj_type") == t, F.lit(r)) for t, r in TYPE_RANK.items()])
    return objects.orderBy(rank, "hash")


def write_pack(objects: DataFrame, path: str) -> str:
    """Writes objects (obj_type, hash, data) as a zstd Parquet pack; returns its checksum, which doesn't depend on row order."""
    packed = objects.select("obj_type", "hash", F.col("data").cast("binary").alias("data")).dropDuplicates(["obj_type", "hash"])
    packed.repartition("hash").sortWithinPartitions("hash").write.option("compression", "zstd").parquet(path)
    return pack_checksum(objects.sparkSession.read.parquet(path))


def pack_checksum(objects: DataFrame) -> str:
    """Digest of the counts and folded digests of each first byte, so no task sees all rows."""
    own = F.xxhash64("obj_type", "hash", "data")
    parts = objects.groupBy(shard_of(F.col("hash"), 256).alias("s")).agg(F.count("*").alias("n"), F.bit_xor(own).alias("x"), F.sum(F.pmod(own, F.lit(1 << 31))).alias("y")).orderBy("s").collect()
    import hashlib

    return hashlib.sha256(repr([tuple(r) for r in parts]).encode()).hexdigest()


def read_pack(spark, path: str, checksum: str | None = None) -> DataFrame:
    """The pack's objects; ValueError if the checksum differs or a chunk isn't what its digest says."""
    objects = spark.read.parquet(path)
    if checksum is not None and pack_checksum(objects) != checksum:
        raise ValueError("the pack's checksum is wrong")
    if not objects.where((F.col("obj_type") == "chunk") & (digest(F.col("data")) != F.col("hash"))).isEmpty():
        raise ValueError("a chunk in the pack isn't what its digest says")
    return objects


def inventory(objects: DataFrame) -> DataFrame:
    """obj_type, n, least, greatest: what a side has of each type."""
    return objects.select("obj_type", "hash").distinct().groupBy("obj_type").agg(F.count("*").alias("n"), F.min("hash").alias("least"), F.max("hash").alias("greatest"))


def over_quota(objects: DataFrame, session_limit: int = SESSION_BYTES, object_limit: int = OBJECT_BYTES) -> DataFrame:
    """One row: what a pack has over its quotas: bytes, too_large (objects over object_limit), refused (either quota is broken)."""
    size = F.octet_length("data").cast("long")
    got = objects.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if(size > object_limit).alias("too_large"))
    return got.withColumn("refused", (F.col("too_large") > 0) | (F.col("bytes") > session_limit))


def ingest_counts(received: DataFrame, held: DataFrame) -> DataFrame:
    """One row: received, stored, duplicates."""
    one = received.groupBy("obj_type", "hash").agg(F.count("*").alias("n"))
    known = held.select("obj_type", "hash").distinct().withColumn("_h", F.lit(True))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return one.join(known, ["obj_type", "hash"], "left").agg(total.alias("received"), F.count_if(F.col("_h").isNull()).alias("stored"), (total - F.count_if(F.col("_h").isNull())).alias("duplicates"))


def finalize(updates: DataFrame, refs: DataFrame) -> DataFrame:
    """ref, status for updates (ref, expected, new, force, fast_forward): ok, or non-fast-forward, or stale if the tip has moved."""
    tip = refs.select(F.col("name").alias("ref"), F.col("target").alias("_tip"))
    moved = ~F.col("_tip").eqNullSafe(F.col("expected"))
    return updates.join(tip, "ref", "left").select("ref", F.when(F.col("force"), "ok").when(moved, "stale").when(~F.col("fast_forward"), "non-fast-forward").otherwise("ok").alias("status"))


def recent_sessions(sessions: DataFrame, limit: int, remote=None) -> DataFrame:
    """The newest sessions, of one remote if given."""
    s = sessions if remote is None else sessions.where(F.col("remote") == remote)
    return s.orderBy(F.desc("started_at"), "session_id").limit(limit)


def resumable(sessions: DataFrame, now: int, ttl: int) -> DataFrame:
    """For each remote and direction the newest session that is running and younger than ttl."""
    live = sessions.where((F.col("status") == "running") & (F.lit(now) - F.col("started_at") < ttl))
    return live.groupBy("remote", "direction").agg(F.max(F.struct("started_at", "session_id")).alias("x")).select("remote", "direction", F.col("x.session_id").alias("session_id"))


def expired(sessions: DataFrame, now: int, ttl: int) -> DataFrame:
    """Running sessions of ttl or older, marked as failed."""
    return sessions.where((F.col("status") == "running") & (F.lit(now) - F.col("started_at") >= ttl)).withColumn("status", F.lit("failed"))


def transfer_totals(sessions: DataFrame) -> DataFrame:
    """remote, direction, sessions, completed, failed."""
    return sessions.groupBy("remote", "direction").agg(F.count("*").alias("sessions"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed")])
